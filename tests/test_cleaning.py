import re
import unicodedata

from pyspark.sql import functions as F

from corpusweft.operators import cleaning as C


def plain(text):
    """The rules one line after the other, with the two states as variables."""
    out, n = [], dict.fromkeys(C.COUNTS, 0)
    contents, cover = False, True
    for k, line in enumerate(re.sub(r"<!--\s*image\s*-->", "", unicodedata.normalize("NFKC", text or "")).splitlines()):
        s = line.strip()
        numbered, dated = C.NUMBERED.match(s), C.DATE.match(s)
        if numbered and not dated:
            cover = False
        why = None
        if C.CONTENTS.match(s):
            contents, why = True, ["toc_lines_removed"]
        elif contents and not numbered:
            why = ["toc_lines_removed"]
        else:
            contents = False
            label = C.LABEL.match(s)
            if not s:
                out.append("")
                continue
            if k == 0 and C.FILE.match(s):
                why = ["front_matter_lines_removed"]
            elif cover and len(s) <= 48 and re.match(r"[A-Z][A-Z0-9 .,&()/_-]{4,}$", s):
                why = ["front_matter_lines_removed", "brand_lines_removed"]
            elif cover and (len(C.COVER.findall(s)) >= 2 or (C.COVER.search(s) and s.count(":") + s.count("：") >= 2) or C.COVER_ALONE.match(s)):
                why = ["front_matter_lines_removed"]
            elif C.FURNITURE.search(s):
                why = ["page_furniture_lines_removed"]
            elif C.LEADERS.search(s) or C.RULE.match(s):
                why = []
            elif dated or label:
                if cover:
                    why = ["front_matter_lines_removed"]
                else:
                    out.append(s.lstrip("#").strip())
                    continue
        if why is None:
            out.append((line if line.lstrip().startswith("|") else re.sub(r"[ \t]{2,}", " ", line)).rstrip())
        else:
            for name in ["lines_removed", *why]:
                n[name] += 1
    return (re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip(), *n.values())


PAGE = """# sample.pdf

## 项目名称 :
## 2024 年 6 月 9 日
版本 页码 2 总页数 37 A
DAYU ELECTRIC <!-- image -->
买方 :
卖方 :
变电站⾃动化⽅案
## 目录
| 1 工厂设计环境 ..............................................................4 |
|---------------------------------------------------------------|
## 1 工厂设计环境
正文内容
"""
ODD = [
    None, "", "\n\n\n\n", PAGE, "## 目录", "## 目录\n\nx\n## 2024 年 1 月 2 日\ny", "## 1 a\nACME CORP\n买方 :\n## 买方 :\n## 2024 年 1 月 2 日\n\n\n\n| a   b |\na   b  ", "# x.PDF\n# y.pdf", "a\x0b# 1 b\x85目录 ## 目录\nlost",
    "## 1 a\n## 目录\nlost\n## 3.2 kept\n## 目录\nlost too", "ＡＢＣＤＥ　ＣＯ\n｜x", "日期: a: b", "x" * 50_000 + "\n" + "买方 :\n" * 3000,
]


def test_cleaner_equals_the_line_by_line_version(spark):
    pages = [r.text for r in spark.sql(C._PAGES, documents=spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("text").collect()]
    texts = ODD + pages
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, lines_removed long").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in C.cleaned(df).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_parsed_page_loses_its_noise_and_other_files_pass(spark):
    df = spark.createDataFrame([(1, PAGE, "/tmp/sample.PDF"), (2, "# title\n\nbody", "/tmp/sample.md"), (3, None, None)], "doc_id long, text string, path string")
    out = {r.doc_id: r for r in C.cleaned_files(df).collect()}
    assert out[1].text == "变电站自动化方案\n## 1 工厂设计环境\n正文内容" and (out[1].cleaner, out[1].brand_lines_removed, out[1].toc_lines_removed) == ("pdf-basic-v1", 1, 3)
    assert (out[2].text, out[2].cleaner, out[2].lines_removed, out[3].text) == ("# title\n\nbody", "noop", 0, "")
    assert C.cleaned_files(df.limit(0)).collect() == []


def test_library_predicates(spark):
    long = "a sentence about the control of the motor and the cooling system that goes on and on for a while"
    rows = [("a  1\nb\t22\nc   333", "PLAIN", None, False, "low", True, False), ("a  1\nb  2\nc  3\nlast", "PLAIN", None, False, "low", True, False), ("a 1\nb 2\nc 3", "PLAIN", None, False, "low", False, False), (long, "PLAIN", "x", False, "low", False, True), (long, "PLAIN", "plan.pdf", False, "low", False, False), (long, "PLAIN", "目录", False, "low", False, False), (long, "PLAIN", "x", True, "low", False, False), (long, "PLAIN", "x", False, "high", False, False), (long * 30, "TABLE", "x", False, "low", False, False), (long * 30, "PLAIN", "x", False, "low", False, True), (" a " * 30, "PLAIN", "x", False, "low", False, False)]
    df = spark.createDataFrame(rows, "text string, kind string, heading string, front boolean, risk string, contents boolean, reusable boolean")
    c = F.col
    for r in df.select("*", C.is_contents(c("text")).alias("x"), C.is_reusable(c("text"), c("kind"), c("heading"), c("front"), c("risk")).alias("y")).collect():
        assert (r.x, r.y) == (r.contents, r.reusable), r


def test_batches_are_cleaned_in_small_parts():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 3_000_000, 20, 700_000, 700_000, 700_000, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    parts = list(C.small([batch, batch.slice(0, 0)]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert all(p.nbytes <= 2 * C.SMALL or p.num_rows == 1 for p in parts) and len(parts) < 7
