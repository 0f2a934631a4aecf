"""Reversible masking of personal data: detection, numbered placeholders, restoring.

Texts have a ``session_id`` and a ``seq``, unique together and of any types. Null texts stay null and have no entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table

#: Entity types in order of precedence, with their label, pattern and the group of the pattern that is meant.
ENTITIES = {
    "ID_CARD": ("ID_Card", r"(?<![0-9A-Za-z])\d{17}[0-9Xx](?![0-9A-Za-z])", 0),
    "PHONE": ("Phone", r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", 0),
    "BANK_CARD": ("BankCard", r"(?<!\d)\d{16,19}(?!\d)", 0),
    "AMOUNT": ("Amount", r"(?<!\d)(?:人民币)?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:亿元|万元|万|亿|元)", 0),
    "PROJECT_CODE": ("Project", r"(?:项目代号|项目编号|项目编码)[：:\s]{0,3}([A-Za-z][A-Za-z0-9_-]{2,24})", 1),
    "COMPANY": ("Company", "", 0),
    "LOCATION": ("Address", r"(?:地址|办公地址|联系地址)[：:\s]{0,3}([一-鿿A-Za-z0-9号弄室楼栋单元区市省路街道镇乡村]{6,80})", 1),
    "PERSON": ("Person", r"(?:联系人|姓名|负责人|签约人|代表人|项目经理|收件人|法人|法定代表人)[：:\s]{0,3}([一-鿿]{2,4})(?=[，。；;、\s]|$|确认|电话|联系电话|负责|签订|与|和)", 1),
    "EMAIL": ("Email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0),
    "IP": ("Network", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0),
}
#: Ends of company names, words that a name does not reach across, and words in front of it that are not part of it.
COMPANY_ENDS = ("股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团", "公司", "研究院", "银行", "医院", "大学")
COMPANY_STOPS = ("法定代表人", "项目经理", "联系人", "负责人", "收件人", "姓名", "确认", "追加", "根据", "分析", "签订", "合同", "甲方", "乙方", "客户", "供应商", "合作方")
COMPANY_LEADS = ("本合同由", "项目由", "请联系", "请联络", "联系人", "联系", "甲方", "乙方", "客户", "供应商", "合作方", "根据", "由")
_LABELS = "|".join(label for label, _, _ in ENTITIES.values())
PLACEHOLDER = re.compile(rf"\[(?:{_LABELS})_[A-Za-z0-9]+\]")
#: Stretches of characters of which names are made, the ends in them, and what a name is: all that is left of a stretch up to an end behind its
#: leading words and the last word that no name reaches across, with the leading words behind that one.
_STRETCH, _END = re.compile(r"(?:[^\W_]|[·（）()])+"), re.compile("|".join(COMPANY_ENDS))
_LEADS, _STOPS = (f"(?:{'|'.join(sorted(words, key=len, reverse=True))})" for words in (COMPANY_LEADS, COMPANY_STOPS))
_NAME = re.compile(rf"{_LEADS}*+(?:.+{_STOPS}{_LEADS}*+)?(.*(?:{'|'.join(COMPANY_ENDS)}))", re.DOTALL)


def company_spans(text: str) -> list[tuple[int, int]]:
    """Company names: one for each end of a name in the text, told by a single pattern over the stretch in front of it."""
    stretches = ((s.start(), s[0]) for s in _STRETCH.finditer(text))
    names = ((at, end, _NAME.fullmatch(run, 0, end.end())) for at, run in stretches for end in _END.finditer(run))
    return [(at + name.start(1), at + name.end(1)) for at, end, name in names if name and len(name[1]) >= len(end[0])]


def spans(text: str) -> list[tuple[int, int, str]]:
    """Detected (start, end, type), not overlapping: precedence first, then the longest, then the earliest."""
    found = []
    for k, (name, (_, pattern, group)) in enumerate(ENTITIES.items()):
        own = company_spans(text) if name == "COMPANY" else [m.span(group) for m in re.finditer(pattern, text)]
        found += [(k, a - b, a, b, name) for a, b in own if text[a:b].strip()]
    taken: list[tuple[int, int, str]] = []
    for _, _, a, b, name in sorted(found):
        if all(b <= s or a >= e for s, e, _ in taken):
            taken.append((a, b, name))
    return sorted(taken)


def detected(rows: DataFrame) -> DataFrame:
    """(session_id, seq, position, start, end, entity, value) of the texts (session_id, seq, text)."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("session_id", "seq")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, n, *s, text[s[0] : s[1]]) for i, text in enumerate(batch.column(2).to_pylist()) if text for n, s in enumerate(spans(text))]
            at, position, start, end, entity, value = ([r[k] for r in own] for k in range(6))
            numbers = (pa.array(x, pa.int32()) for x in (position, start, end))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in range(2)), *numbers, pa.array(entity, pa.string()), pa.array(value, pa.string())], names=["session_id", "seq", "position", "start", "end", "entity", "value"])

    return rows.select("session_id", "seq", "text").mapInArrow(run, f"session_id {kinds[0]}, seq {kinds[1]}, position int, start int, end int, entity string, value string")


def letters(n: Column) -> Column:
    """1, 2, ... as A to Z, AA, AB and so on, up to five letters (12 million); more are an error."""
    out, below = None, 0
    for size in range(1, 6):
        rest = n - 1 - below
        code = F.concat(*(F.char(65 + F.floor(rest / 26**i) % 26) for i in range(size - 1, -1, -1)))
        below += 26**size
        out = F.when(n <= below, code) if out is None else out.when(n <= below, code)
    return out.when(n.isNotNull(), F.raise_error(F.lit("more than five letters of a placeholder")).cast("string"))


def placeholder(entity: Column, number: Column) -> Column:
    label = F.element_at(F.create_map(*(F.lit(x) for k, (v, _, _) in ENTITIES.items() for x in (k, v))), entity)
    return F.concat(F.lit("["), label, F.lit("_"), F.when(entity == "COMPANY", letters(number)).otherwise(number.cast("string")), F.lit("]"))


def numbered(found: DataFrame) -> DataFrame:
    """The detected rows with ``placeholder``: numbers by first occurrence within a session and entity; a value keeps its number."""
    of_value = Window.partitionBy("session_id", "entity", "value")
    of_entity = Window.partitionBy("session_id", "entity").orderBy("_first", "value")
    first = found.withColumn("_first", F.min(F.struct("seq", "position")).over(of_value))
    return first.withColumn("placeholder", placeholder(F.col("entity"), F.dense_rank().over(of_entity))).drop("_first")


def masked(rows: DataFrame) -> DataFrame:
    """The rows with ``masked`` text and ``mapping`` (placeholder to value). Texts are searched once."""
    per_text = numbered(detected(rows)).groupBy("session_id", "seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "value"))).alias("spans"))
    joined = rows.select("session_id", "seq", "text").join(per_text, ["session_id", "seq"], "left")
    none = F.array().cast("array<struct<start:int,end:int,placeholder:string,value:string>>")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substr("text", s["at"] + 1, x["start"] - s["at"]), x["placeholder"]).alias("out"), x["end"].alias("at"))
    text = F.aggregate(F.coalesce("spans", none), start, step, lambda s: F.concat(s["out"], F.substr("text", s["at"] + 1)))
    pairs = F.array_distinct(F.transform(F.coalesce("spans", none), lambda x: F.struct(x["placeholder"], x["value"])))
    return joined.select("session_id", "seq", text.alias("masked"), F.map_from_entries(pairs).alias("mapping"))


def restore(text: str | None, mapping: dict[str, str]) -> str | None:
    return text if text is None else PLACEHOLDER.sub(lambda m: mapping.get(m[0], m[0]), text)


def restored(text: Column, mapping: Column) -> Column:
    """A text with its placeholders replaced by the values of a map; unknown ones stay."""
    held = F.regexp_extract_all(text, F.lit(PLACEHOLDER.pattern), 0)
    parts = F.split(text, PLACEHOLDER.pattern)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.coalesce(mapping[F.get(held, i)], F.get(held, i)), F.lit("")))), "")


_EMAIL = ENTITIES["EMAIL"][1]
_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


@query(
    rf"""WITH t AS (SELECT conv_id AS session_id, turn AS seq, text, regexp_extract_all(text, '{_EMAIL}') AS v FROM conversations), m AS (SELECT session_id, seq, unnest(v) AS value, unnest(range(0, len(v))) AS p FROM t), f AS (SELECT session_id, value, min((seq, p)) AS first FROM m GROUP BY 1, 2),
    n AS (SELECT session_id, value, '[Email_' || dense_rank() OVER (PARTITION BY session_id ORDER BY first, value) || ']' AS placeholder FROM f), x AS (SELECT session_id, seq, list({{'p': p, 'value': value, 'ph': placeholder}} ORDER BY p) AS l FROM m JOIN n USING (session_id, value) GROUP BY 1, 2),
    w AS (SELECT t.session_id, t.seq, text, coalesce(l, []) AS l FROM t LEFT JOIN x USING (session_id, seq)), y AS (SELECT session_id, seq, l, string_split_regex(text, '{_EMAIL}') AS parts FROM w)
    SELECT session_id, seq, array_to_string(list_transform(parts, lambda s, i: s || coalesce(l[i].ph, '')), '') AS masked, len(list_distinct(list_transform(l, lambda z: z.ph)))::INT AS n_values FROM y"""
)
def mask_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with personal data replaced by numbered placeholders; the SQL twin knows mail addresses, which are all that they hold."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text")
    return masked(turns).select("session_id", "seq", "masked", F.size("mapping").alias("n_values"))


@query(
    rf"""WITH t AS (SELECT source, doc_id, regexp_extract_all(text, '{_EMAIL}') AS v FROM documents),
    m AS (SELECT source, doc_id, unnest(v) AS value, unnest(range(0, len(v))) AS p FROM t), f AS (SELECT source, value, min((doc_id, p)) AS first FROM m GROUP BY 1, 2), r AS (SELECT source, value, dense_rank() OVER (PARTITION BY source ORDER BY first, value) AS n FROM f)
    SELECT source, value, '[Email_' || n || ']' AS placeholder, CASE WHEN n <= 26 THEN chr(64 + n::INT) WHEN n <= 702 THEN chr(64 + ((n - 1) // 26)::INT) || chr(65 + ((n - 1) % 26)::INT) END AS letters FROM r"""
)
def placeholder_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of addresses by first occurrence in each source, and the letters that a company of that number would have."""
    matches = F.regexp_extract_all("text", F.lit(_EMAIL), 0)
    found = table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.lit("EMAIL").alias("entity"), F.posexplode(matches).alias("position", "value"))
    rows = numbered(found).select(F.col("session_id").alias("source"), "value", "placeholder").distinct()
    return rows.withColumn("letters", letters(F.regexp_extract("placeholder", "_([0-9]+)", 1).cast("int")))
