"""Checks of programs and pages on small cases whose results are known."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import code as C
from tessera.functions import html as H

GOOD = "#include <stdio.h>\nint main() { int x; if (x) { return 0; } return 1; }\n"


def of(spark, text, *columns):
    return spark.createDataFrame([(text,)], "a string").select(*[c(F.col("a")).alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ('a "b\\"c" d', "a        d"), ("x // y\nz", "x     \nz"), ("x /* y\n*/ z", "x         z"), ("c = '\"';\"}\"", "c =    ;   "), ("c = '\\'' {", "c =      {"), ("/* open", "       "), ("", ""),
    ],
)
def test_masked(spark, code, want):
    assert of(spark, code, C.masked)[0] == want


def test_masked_keeps_the_length_of_long_code(spark):
    code = ('printf("' + "x" * 20_000 + '\\n"); // ' + "y" * 5_000 + "\n") * 5
    got = of(spark, code, C.masked)[0]
    assert len(got) == len(code) and "x" not in got and got.count("printf(") == 5


@pytest.mark.parametrize(
    ("code", "errors", "warnings"),
    [
        (GOOD, [], []),
        ("```c\n" + GOOD, ["markdown_fence"], []),
        ('int x; char s[9]; scanf("%s%s", &x, s);', ["scanf_s_type:x"], []),
        ('char c; scanf("%s", &c);', ["scanf_s_type:c"], ["scanf_s_char:c"]),
        ('scanf("%s", q);', [], ["scanf_s_unknown:q"]),
        ('float f; double d; double e[2]; scanf("%d %i %d", &f, &d, &e);', ["scanf_d_float:f", "scanf_d_float:d"], []),
        ('int n; scanf("%f", &n);', ["scanf_f_int:n"], []),
        ("int a; char b[3]; strcmp(a, b);", ["strcmp_int:a"], ["strcmp_without_header"]),
        ("int main(void) { x(); }", [], ["main_without_return"]),
        ("rand(); ", [], ["rand_without_srand"]),
        ("srand(1); rand() % 6;", [], ["srand_without_time", "repeated_random"]),
        ("srand(time(0)); rand() % 6; seen[1];", [], ["time_without_header"]),
        ("while (1) { if (x) { break; } } while ( 1 ) { y(); /* break */ }", [], []),
        ("while (1) { y(); } while (1) { z(); }", [], ["endless_loop", "endless_loop"]),
        ("for (i = 0; i < n; i++) a[i - 1] = 2; if (0) {} while (0) {}", [], ["index_below_zero", "if_zero", "while_zero"]),
    ],
)
def test_static_checks(spark, code, errors, warnings):
    got = of(spark, code, lambda c: C.static_checks(c)[0], lambda c: C.static_checks(c)[1], lambda c: C.risk(*C.static_checks(c)))
    assert (got[0], got[1]) == (errors, warnings)
    assert got[2] == pytest.approx(min(1, 0.35 * len(errors) + 0.08 * len(warnings)))


@pytest.mark.parametrize(
    ("answer", "code", "method"),
    [
        (f"Here:\n```c\n{GOOD}```\nbye {{", GOOD.strip(), "fence"),
        (f"Here: {GOOD} int f() {{ }} and more", (GOOD + " int f() { }").strip(), "heuristic"),
        ("#include <x> int main( no braces", "#include <x> int main( no braces", "none"),
        (" plain ", "plain", "none"),
    ],
)
def test_extraction(spark, answer, code, method):
    assert tuple(of(spark, answer, lambda c: C.extracted(c)[0], lambda c: C.extracted(c)[1])) == (code, method)


def test_strict_extraction(spark):
    assert of(spark, f"```\nint x;\n``` then {GOOD}", C.extracted_strict)[0] == GOOD.strip()


def test_structure(spark):
    parts = [lambda c: C.structure(c)[0], lambda c: C.structure(c)[1], lambda c: C.structure(c)[2]]
    assert tuple(of(spark, GOOD, *parts)) == ([], 1.0, True)
    assert tuple(of(spark, 'int main() { printf("}"); scanf("%d", &a, &b); ', *parts)) == (["has_include", "balanced_braces", "has_control_flow", "scanf_format"], 0.5, False)
    assert of(spark, ") (", lambda c: C.balanced(c, "(", ")"))[0] is False


def test_outputs(spark):
    got = of(spark, "\x1b[31ma\x1b[0m\r\n⠋ loading\nx = -3.5 of 7.", C.normalised_output, C.last_number, C.without_fences)
    assert (got[0], got[1]) == ("a\nx = -3.5 of 7.", 7.0)
    assert of(spark, "```c\nint x;\n```", C.without_fences)[0] == "int x;"


PAGE = "<html><head><title>T</title><script>x < y</script></head><body><nav><p>menu</p></nav><div class='a'><h2 id=z>One &amp; two</h2><p></p><p>Some  <b>bold</b>\n text &lt;</p><pre>\nint x;\n  y</pre></div><p>3. What is it?</p><ul><li>a</li></ul></body></html>"


def test_cleaned_page(spark):
    got = of(spark, PAGE, H.cleaned)[0]
    assert "menu" not in got and "x < y" not in got and "class" not in got and "<div" not in got
    assert "<h2>One &amp; two</h2>" in got and "text &lt;</p>" in got and "<pre>\nint x;\n  y</pre>" in got and "<p></p>" not in got
    assert not re.search("\n{3}", got) and of(spark, None, H.cleaned)[0] == ""


def test_clean_pages_leaves_cut_references_as_text(spark, tmp_path):
    """As its SQL has it: a title that is cut within a reference keeps what is left of it; the operator alone decodes as browsers do."""
    import oracle

    from tessera.plans import catalogue

    page = "<title>a &amp;&amp&ampRa</title><h1>x&amp&lt;&lt</h1><p>&amp;lt; &quot;&#39;&nbsp;z &amp;#39;</p><pre>&nbsp;&amp</pre>"
    spark.createDataFrame([(1, page), (2, None)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "pages.parquet")
    (tmp_path / "in").mkdir()
    (tmp_path / "pages.parquet").rename(tmp_path / "in/pages.parquet")
    oracle.check(spark, str(tmp_path / "in"), catalogue.QUERIES["clean_pages"], catalogue.SQL["clean_pages"])
    assert of(spark, "<p>a &ampb &eacute;</p>", H.cleaned)[0] == "<p>a &amp;b é</p>"


def test_chunks(spark):
    df = spark.createDataFrame([(7, PAGE), (8, None), (9, "<p>" + "a" * 90 + "</p><p>" + "b" * 20 + "</p><p>c</p>")], "id long, html string")
    got = [(r.id, r.chunk_id, r.section, r.content, r.kind, r.tokens) for r in H.chunks(df, "id", "html", 100).orderBy("id", "chunk_id").collect()]
    assert got == [
        (7, "7_0000", "", "menu", "text", 1),
        (7, "7_0001", "One & two", "Some bold text <", "text", 3),
        (7, "7_0002", "One & two", "int x;\n  y", "code", 2),
        (7, "7_0003", "Question 3", "3. What is it?\na", "question", 3),
        (9, "9_0000", "", "a" * 90, "text", 18),
        (9, "9_0001", "", "b" * 20 + "\nc", "text", 4),
    ]
