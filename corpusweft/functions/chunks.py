"""Chunks of text: tables and their profiles, formulas, and the reasons that keep a chunk out of an index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of tables, formulas, figures, page furniture and noise.
SEPARATOR_CELL, NUMBER = r"^:?-{2,}:?$", r"[0-9]+(\.[0-9]+)?"
UNIT = r"(?i)(kV|V|A|kA|mA|Hz|kW|MW|mm|cm|m|kg|Nm|rpm|ms|s|%|Ω|MΩ|℃|bar|MPa|m3/h|L/min)"
SPEC_HEADER = r"(?i)(参数|项目|规格|型号|名称|单位|数值|说明|备注|item|spec|model|type)"
GARBLED_RUN = r"[#*@$]{3,}"
MATH = r"(∑|∫|√|≤|≥|≈|Ω|μ|α|β|γ|×|÷|=|\^|[_]|/\s*[A-Za-z])"
SCRIPTS = "[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿᵃᵇᶜᵈᵉᶠᵍʰᶦʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ]"
#: MATH or SCRIPTS as one pattern, which looks closer only at characters that either can begin with.
FORMULA = r"(?=[=^_/\x80-\x{10FFFF}])([∑∫√≤≥≈Ωμαβγ×÷=^_]|/\s*[A-Za-z]|" + SCRIPTS + ")"
GARBLED = "[Ă₴₩÷�ÃÐÑþÿ]"
FIGURE = r"(?i)(波形|波特图|时序图|点阵图|电路图|原理图|接线图|示意图|电气图|FFT|Bode|waveform|circuit|schematic|diagram)"
FURNITURE = "(版本|页码|总页数|项目名称|买方|卖方)"
FIGURE_MARKERS = ("如下", "见下图", "详见", "原理图", "波形", "示意图", "接线图")
PROSE_MARKERS = ("因此", "采用", "控制", "系统", "支持", "说明", "过程", "要求")
NUMERIC_CELL, NUMERIC_HEADING = r"^[0-9.\-+/%()]+$", r"^[0-9.\-+/%()\s]+$"
WORD = r"[A-Za-z]{2,}|[一-鿿]{2,}|[0-9]+(\.[0-9]+)?"
STOP_WORDS = ("of", "and", "or", "to", "for", "the", "with", "by", "from")
#: Raised and lowered characters and what they stand for.
RAISED, RAISED_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿᵃᵇᶜᵈᵉᶠᵍʰᶦʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻ", "0123456789+-=()nabcdefghijklmoprstuvwxyz"
LOWERED, LOWERED_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ", "0123456789+-=()aehijklmnoprstuvx"
#: Sizes of tables, headings and fragments.
TABLE_CHARS, TABLE_ROWS, HEADING_CHARS, FURNITURE_CHARS, FRONT_CHUNKS, FIGURE_CHARS = 2200, 28, 60, 120, 6, 260
GARBLED_SHARE, CELL_SHARE, CELL_CHARS = 0.12, 0.25, 8


def once(value: Column, formula) -> Column:
    """A formula over a value that is worked out once, however often the formula names it."""
    return F.transform(F.array(value), formula)[0]


def flat(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stripped(text: Column) -> Column:
    """The text without the white space of a pattern's \\s around it."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")


def is_table(text: Column) -> Column:
    return text.contains("|") & text.contains("\n|")


def table_rows(text: Column) -> Column:
    """An array of rows of trimmed cells: lines with a bar, without empty and separator rows."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(stripped(line), r"^\|+|\|+$", ""), r"\|"), stripped)
    rows = F.transform(F.filter(lines(text), lambda x: x.contains("|")), cells)
    return F.filter(rows, lambda row: F.exists(row, lambda c: c != "") & ~F.forall(row, lambda c: c.rlike(SEPARATOR_CELL)))


def _garbled_cell(cell: Column) -> Column:
    marks = F.length(cell) - F.length(F.translate(cell, "#*@$", ""))
    return cell.rlike(GARBLED) | cell.rlike(GARBLED_RUN) | ((F.length(cell) >= CELL_CHARS) & (marks / F.length(cell) >= CELL_SHARE))


def table_profile(text: Column) -> Column:
    """struct<profile, confidence, n_rows, n_columns, numeric_ratio, unit_hits, garbled_ratio, header, flags>."""
    counted = lambda r: F.struct(
        F.size(r).alias("n_rows"),
        F.coalesce(F.array_max(F.transform(r, lambda row: F.size(row))), F.lit(0)).alias("n_columns"),
        F.filter(F.flatten(r), lambda c: c != "").alias("cells"),
        F.when(F.size(r) > 0, F.slice(F.get(r, F.lit(0)), 1, 8)).otherwise(F.array().cast("array<string>")).alias("header"),
    )

    def measured(k: Column) -> Column:
        n = F.greatest(F.size(k["cells"]), F.lit(1))
        hits = lambda test: F.size(F.filter(k["cells"], test))
        return F.struct(k["n_rows"].alias("n_rows"), k["n_columns"].alias("n_columns"), k["header"].alias("header"), (hits(lambda c: c.rlike(NUMBER)) / n).alias("numeric"), hits(lambda c: c.rlike(UNIT)).alias("units"), (hits(_garbled_cell) / n).alias("garbled"), F.exists(k["header"], lambda c: c.rlike(SPEC_HEADER)).alias("spec"))

    def named(m: Column) -> Column:
        numeric, units, garbled, spec = m["numeric"], m["units"], m["garbled"], m["spec"]
        empty, bad = m["n_rows"] == 0, garbled >= GARBLED_SHARE
        matrix = (m["n_rows"] >= 10) & (numeric >= 0.3)
        sheet = (units >= 2) | spec
        flags = F.array_compact(
            F.array(
                F.when(empty, F.lit("empty_or_unparsed_table")),
                F.when(bad, F.lit("garbled_cells")),
                F.when(units >= 2, F.lit("unit_dense")),
                F.when(numeric >= 0.35, F.lit("numeric_dense")),
                F.when(spec, F.lit("spec_headers")),
            )
        )
        name = F.when(empty, F.lit("sparse_lookup")).when(bad, F.lit("garbled_table")).when(matrix, F.lit("parameter_matrix")).when(sheet, F.lit("spec_sheet")).otherwise(F.lit("sparse_lookup"))
        sure = F.when(empty, F.lit(0.45)).when(bad, F.least(F.lit(0.96), 0.58 + garbled)).when(matrix, F.lit(0.84)).when(sheet, F.lit(0.77)).otherwise(F.lit(0.69))
        return F.struct(name.alias("profile"), sure.alias("confidence"), m["n_rows"].alias("n_rows"), m["n_columns"].alias("n_columns"), numeric.alias("numeric_ratio"), units.alias("unit_hits"), garbled.alias("garbled_ratio"), m["header"].alias("header"), flags.alias("flags"))

    return once(once(once(table_rows(text), counted), measured), named)


def is_formula(text: Column) -> Column:
    return text.rlike(FORMULA)


def is_garbled_formula(text: Column) -> Column:
    return text.rlike(GARBLED)


def formula_hint(text: Column) -> Column:
    """A line's raised runs as ^{..} and lowered runs as _{..}; null where it has none."""
    raised = F.regexp_replace(text, f"([{RAISED}]+)", r"^\{$1\}")
    both = F.regexp_replace(raised, f"([{LOWERED}]+)", r"_\{$1\}")
    return F.when(text.rlike(SCRIPTS), F.translate(F.translate(both, RAISED, RAISED_PLAIN), LOWERED, LOWERED_PLAIN))


def formula_lines(text: Column) -> Column:
    """array<struct<line, text, hint, garbled>> of the lines that look like mathematics."""
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    found = F.filter(numbered, lambda x: is_formula(x["text"]))  # what looks like mathematics is no white space
    told = lambda line, t: F.struct(line.alias("line"), t.alias("text"), formula_hint(t).alias("hint"), is_garbled_formula(t).alias("garbled"))
    return F.transform(found, lambda x: told(x["line"], stripped(x["text"])))


def without_marks(line: Column) -> Column:
    return stripped(F.regexp_replace(line, r"^\s*#+\s*", ""))


#: Fixed value: the most visible characters with which a chunk may say too little.
VISIBLE_MOST = 40


def is_low_signal(text: Column, heading: Column) -> Column:
    """Whether a plain chunk with its heading says too little."""
    filled = F.filter(F.transform(lines(text), stripped), lambda x: x != "")
    own = F.filter(filled, lambda x: ~x.startswith("#"))
    body = F.array_join(F.filter(F.transform(F.when(F.size(own) > 0, own).otherwise(filled), without_marks), lambda x: x != ""), " ")
    title = without_marks(heading)
    both = stripped(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(body, F.lit(""))))
    parts = F.struct(F.length(F.regexp_replace(both, r"\s", "")).alias("visible"), body.alias("body"), title.alias("title"), both.alias("both"))

    def judged(x: Column) -> Column:
        cyrillic = F.length(F.regexp_replace(x["both"], "[^Ѐ-ӿ]", ""))
        return (
            (x["visible"] == 0)
            | ((x["visible"] <= VISIBLE_MOST) & (cyrillic / F.greatest(x["visible"], F.lit(1)) >= 0.12))
            | ((F.length(x["body"]) <= 5) & F.lower(x["body"]).isin(*STOP_WORDS) & (F.length(x["title"]) <= 20))
            | ((x["visible"] <= 24) & (F.regexp_count(x["both"], F.lit(WORD)) <= 2) & ~x["both"].rlike("[一-鿿]{2,}"))
        )

    # without headings the text itself is the body, and one that says more than VISIBLE_MOST characters is never judged further
    plenty = ~text.contains("#") & (F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) > VISIBLE_MOST)
    return F.when(plenty, F.lit(False)).otherwise(once(parts, judged))


def is_numeric_fragment(profile: Column, heading: Column) -> Column:
    """Whether a table (its profile) is a piece of numbers without words."""
    header = F.filter(profile["header"], lambda c: c != "")
    numbers = (F.size(header) > 0) & F.forall(header, lambda c: c.rlike(NUMERIC_CELL))
    return (profile["profile"] == "sparse_lookup") & (profile["n_rows"] <= 4) & (profile["numeric_ratio"] >= 0.8) & (numbers | stripped(heading).rlike(NUMERIC_HEADING))


def noise_reasons(text: Column, kind: Column, heading: Column) -> Column:
    """Why a chunk is noise: empty, a low-signal plain fragment, a garbled table or a piece of numbers."""
    of_table = lambda p: F.when(p["profile"] == "garbled_table", F.lit("garbled_table_fragment")).when(is_numeric_fragment(p, heading), F.lit("numeric_table_fragment"))
    plain, table = F.coalesce(F.upper(kind), F.lit("PLAIN")) == "PLAIN", F.upper(kind) == "TABLE"
    empty = stripped(text) == ""
    return F.array_compact(
        F.array(
            F.when(empty, F.lit("empty_chunk")),
            F.when(~empty & plain & is_low_signal(stripped(text), heading), F.lit("low_signal_plain_fragment")),
            F.when(~empty & table, once(table_profile(stripped(text)), of_table)),
        )
    )


def is_figure_reference(text: Column, kind: Column) -> Column:
    count = lambda marks: sum((text.contains(m).cast("int") for m in marks), F.lit(0))
    return text.rlike(FIGURE) & (kind != "TABLE") & ((F.length(text) <= FIGURE_CHARS) | ((count(FIGURE_MARKERS) >= 2) & (count(PROSE_MARKERS) == 0)))


def ingestion_reasons(text: Column, kind: Column, place: Column, heading: Column) -> Column:
    """All reasons that keep a chunk out of the index: an array, empty for a good one."""
    rows = F.size(F.filter(lines(text), lambda x: x.contains("|")))

    def own(t: Column) -> Column:
        filled = F.filter(F.transform(lines(text), stripped), lambda x: x != "")
        heading_only = (kind == "PLAIN") & (F.length(t) <= HEADING_CHARS) & t.startswith("#") & F.forall(filled, lambda x: x.startswith("#"))
        furniture = t.rlike(FURNITURE)
        return F.array_compact(
            F.array(
                F.when((place <= FRONT_CHUNKS) & furniture, F.lit("front_matter_noise")),
                F.when(heading_only, F.lit("heading_only")),
                F.when((F.length(t) <= FURNITURE_CHARS) & furniture, F.lit("page_furniture")),
                F.when((kind == "TABLE") & ((F.length(text) > TABLE_CHARS) | (rows > TABLE_ROWS)), F.lit("oversized_table")),
                F.when(is_garbled_formula(t), F.lit("garbled_formula_text")),
                F.when(is_figure_reference(t, kind), F.lit("figure_reference_only")),
            )
        )

    return F.array_distinct(F.concat(once(flat(text), own), noise_reasons(text, kind, heading)))


def preserved_for_assets(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(F.lit("oversized_table"), F.lit("garbled_table_fragment")))


def needs_review(text: Column, reasons: Column) -> Column:
    return (F.size(reasons) > 0) | once(flat(text), lambda t: t.rlike(FIGURE) | is_formula(t))


def risk_level(text: Column, place: Column) -> Column:
    """high for garbled formulas; medium for tables, front matter, figures and formulas; else low."""
    def level(t: Column) -> Column:
        front = (place <= FRONT_CHUNKS) & t.rlike(FURNITURE)
        return F.when(is_garbled_formula(t), F.lit("high")).when(is_table(text) | front | t.rlike(FIGURE) | is_formula(t), F.lit("medium")).otherwise(F.lit("low"))

    return once(flat(text), level)
