"""Text expressions against Python, on hand-written edge cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftstone.functions import text as T


def values(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1).select(column).collect()]


def python_clean(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    t = re.sub("[ \t ]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


CASES = ["a\r\nb\rc", "x  y\t z", "\n\n\n a \n\n\n\nb", "café-\nüber a-\nb-\nc", "  trim　\n", "a\n \n \nb", "", "   ", "self-\n 1", "\U0001f44d\U0001f3fd-\nx"]


def test_clean_text(spark):
    assert values(spark, CASES, T.clean_text(F.col("t"))) == [python_clean(t) for t in CASES]


def test_paths(spark):
    rows = ["a/b_c-d.tar.gz", "x.md", "dir.with/dot", ".hidden", "_a-"]
    assert values(spark, rows, T.title_from_path(F.col("t"))) == ["b c d.tar", "x", "dot", ".hidden", "a"]
    assert values(spark, rows, T.suffix(F.col("t"))) == [".gz", ".md", "", "", ""]
    assert values(spark, ["file:///data/x/a%20b+c.md", "/data/x/y.md", "/else/y.md"], T.relative_path(F.col("t"), "/data/x/")) == ["a b+c.md", "y.md", "/else/y.md"]


def test_headers_and_locations(spark):
    rows = [("", "s.md", None), ("Title", "s.md", 0), ("Title", "s.md", 3), (None, "s.md", 1)]
    schema = "t string, s string, p int"
    assert values(spark, rows, T.header(F.col("t"), F.col("s"), F.col("p")), schema) == ["[s.md]", "[Title]", "[Title - p.3]", "[s.md - p.1]"]
    assert values(spark, [("", None, 2), ("", "s", None)], T.location(F.col("s"), F.col("p")), schema) == ["unknown, page 2", "s"]


def test_snippet_bounds(spark):
    assert [len(x) for x in values(spark, ["a" * 300, "a" * 301], T.snippet(F.col("t")))] == [300, 303]


def test_fixed_windows_are_slices(spark):
    for size, overlap in ((5, 0), (5, 2), (7, 6)):
        texts = ["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(25)]
        for text, got in zip(texts, values(spark, texts, T.fixed_windows(F.col("t"), size, overlap)), strict=True):
            assert all(w == text[i * (size - overlap) :][:size] for i, w in enumerate(got))
            assert "".join([got[0], *(w[overlap:] for w in got[1:])]) == text


def test_include_directives(spark):
    rows = ['{* ../../a/b.py hl[2] title["x/y.py"] *}', "{* ../c.sh *}", "no"]
    assert values(spark, rows, T.include_path(T.include_target(F.col("t")))) == ["a/b.py", "c.sh", ""]
    assert values(spark, rows[:2], T.include_caption(F.col("t"))) == ["x/y.py", "c.sh"]


def test_admonitions(spark):
    rows = ["/// note | A title\nx\n///\n", "//// WARNING\n/// tip\ny\n///\n////", "plain", "/// note | \nz\n///", "a\n///\nword\nb"]

    def python(t):
        label = lambda m: f"**{m[1].capitalize()}:" + (f" {m[2].strip()}" if (m[2] or "").strip() else "") + "**"
        return re.sub(r"(?m)^/{3,}\s*$", "", re.sub(r"(?m)^/{3,}\s+(\w+)(?:\s*\|\s*(.*))?$", label, t))

    assert python(rows[1]) == "**Warning:**\n**Tip:**\ny\n\n"
    assert values(spark, rows, T.flatten_admonitions(F.col("t"))) == [python(t) for t in rows]
    assert values(spark, ["## A { #a-b }\n\nx", "y {#q}"], T.strip_anchors(F.col("t"))) == ["## A\nx", "y"]


def test_hints_and_citations(spark):
    assert values(spark, ["Retry In 2.5s", "'retryDelay': '7s'", "no", "retry in ..s"], T.retry_hint(F.col("t"))) == [2.5, 7.0, None, None]
    assert values(spark, ["[1][22] x [a] [3"], T.cited_numbers(F.col("t"))) == [[1, 22]]


def test_html(spark):
    page = "<html><head><title> A &amp;\n B </title><script>var t='</p>'</script></head><body><nav>no</nav><!-- <p>no</p> --><p>One&nbsp;two<br>three</p><footer>no</footer></body></html>"
    assert values(spark, [page], T.html_text(F.col("t"))) == ["One two\nthree"]
    assert values(spark, [page, "<p>"], T.html_title(F.col("t"), F.lit("stem"))) == ["A & B", "stem"]
