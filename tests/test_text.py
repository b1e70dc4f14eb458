import random

import pytest
from pyspark.sql import functions as F

from docloom.config import EngineConfig
from docloom.functions import classify, text
from docloom.operators import chunking, filters


def values(spark, rows, column):
    """column(F.col('x')) over one-column rows, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    rows = ["a\r\nb", "a\n\n\n\nb\n\nc", "wel-\nl known é-\nop", "x \n \ny", None]
    assert values(spark, rows, text.normalize) == ["a\nb", "a\nb\nc", "well known éop", "x\ny", None]


def test_deidentify(spark):
    rows = ["12345678901", "123456789012", "12345678901234567X", "电话12345678901号", "a.b@c.de on 2024-1-02 at 9:30 or 10：15", "12345 123456"]
    assert values(spark, rows, text.deidentify) == ["[PHONE]", "[NUMBER]", "[ID]", "电话12345678901号", "[EMAIL] on [DATE] at [TIME] or [TIME]", "12345 [NUMBER]"]


def test_abstract(spark):
    prefix = text.ABSTRACT_PREFIX
    many = " ".join(f"word{'x' * i}" for i in range(30))
    out = values(spark, ["The  wound is [PHONE]", "the of", "伤口", many], text.abstract_query)
    assert out[:3] == [prefix + "wound phone", prefix, prefix]
    assert len(out[3].removeprefix(prefix).split()) == 18


def test_trim_title_doi(spark):
    assert values(spark, [" a  b ", "a b  c d"], lambda c: text.trim_to_words(c, 3)) == ["a  b", "a b c"]
    page = "short\nA line that is longer than twenty\nThe longest line of all, by Smith et al, does not count\nClinical GUIDELINE for everybody"
    assert values(spark, [page, "tiny", "first line of twenty-one!\nother line of twentyone!!"], text.title) == ["Clinical GUIDELINE for everybody", None, "first line of twenty-one!"]
    assert values(spark, ["see 10.1234/AbC-1 x", "none"], text.doi) == ["10.1234/AbC-1", None]


def test_clean_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><p>a &amp; b<br>c</p><!-- x --><footer>f</footer></body>"
    assert values(spark, [page], text.clean_html) == ["T\na & b\nc"]


def test_prompt(spark):
    df = spark.range(1).select(text.prompt(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i.cast("string")), F.lit("why?")).alias("p"))
    prompt = df.first().p
    assert prompt.endswith("Patient question:\nwhy?") and "\n20\n" in prompt and "\n21\n" not in prompt


def test_classify(spark):
    assert values(spark, ["I will SUE over the refund", "rules about suing", "fake personal  info"], classify.unsuitable_labels) == [["hospital_regulations", "medical_law"], [], ["physician_privacy", "disruptive"]]
    assert values(spark, ["Abstract: x", "plain", "x" * 2000 + "图"], classify.is_academic) == [True, False, False]
    assert values(spark, ["目录 前言", "图 目录 前言", "目录", "第一章 第1章"], classify.is_book) == [True, False, False, True]
    assert values(spark, ["习题 小说", "小说", "医", "x"], classify.book_type) == ["textbook", "novel", "drug", "unknown"]


def test_windows(spark):
    assert [len(x) for x in values(spark, ["", "a" * 2200, "a" * 2201, "a" * 4200, "a" * 4201], chunking.window_chunks)] == [1, 1, 2, 2, 3]
    assert values(spark, ["a" * 2000 + " " * 250], chunking.window_chunks) == [["a" * 2000]]
    with pytest.raises(ValueError):
        chunking.window_chunks(F.lit("x"), 10, 10)


def test_packs(spark):
    assert values(spark, ["aa. bb! cc", "?!", "no end"], lambda c: chunking.pack_sentences(c, 7)) == [["aa. ", "bb! cc"], [], ["no end"]]
    assert values(spark, ["ab cd efg", ""], lambda c: chunking.pack_words(c, 6)) == [["ab cd", "efg"], []]
    assert values(spark, ["a\nb\n\nc\nd"], lambda c: chunking.pack_lines(c, 100)) == [["a\nb", "c\nd"]]
    assert values(spark, ["p\n\nq\n\nlong one. and two."], lambda c: chunking.pack_paragraphs(c, 10)) == [["p\n\nq", "long one. ", "and two."]]
    five, six = ("refs" + "".join(f"\n[{i}] r{i}" for i in range(1, n + 1)) for n in (4, 5))
    assert [len(x) for x in values(spark, [five, six], chunking.split_references)] == [1, 2]
    assert values(spark, ["zh Abstract: en ", "x" * 9], lambda c: chunking.split_abstract(c, 5)) == [["zh", "Abstract:en"], ["xxxxx"]]
    assert values(spark, ["head\nRESULTS\na\nb\nCONCLUSION"], chunking.academic_sections) == [["head", "【RESULTS】\na\nb"]]
    assert values(spark, ["x【性状】y"], chunking.split_drug) == [["x\n性状\ny"]]


def test_filters(spark):
    rows = ["a" * 14, "a" * 15, "abc" + "." * 12, "ab" + "." * 13, "é" * 20, "nonetheless it is fine here"]
    assert values(spark, rows, filters.keep_chunk) == [False, True, False, False, False, False]
    df = spark.range(1).select(filters.drop_contained(F.array(*map(F.lit, ["abc", "ab", "abcd", "x", "abcd"]))).alias("k"))
    assert df.first().k == ["abcd", "x", "abcd"]


def test_no_python_in_native_plans(spark):
    df = spark.range(3).select(chunking.pack_sentences(text.deidentify(F.col("id").cast("string"))).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_config(monkeypatch):
    monkeypatch.setenv("DOCLOOM_THETA", "0.5")
    assert EngineConfig.from_env().theta == 0.5 and EngineConfig().theta == 0.75
    with pytest.raises(ValueError):
        EngineConfig(service_url="https://api.openai.com/v1").assert_internal()


def packed_lines(text, size):
    done, cur = [], ""
    for line in text.split("\n"):
        if len(cur) + len(line) <= size:
            cur = f"{cur}\n{line}"
        else:
            done += [cur.strip()] if cur else []
            cur = line
    return done + ([cur.strip()] if cur else [])


def paper_sections(text):
    done, title, body = [], "", []
    for line in [*filter(None, map(str.strip, text.split("\n"))), None]:
        if line is None or line in ("RESULTS", "Abstract", "结论"):
            done += ["\n".join([*filter(None, [title]), *body])] if body else []
            title, body = f"【{line}】", []
        else:
            body.append(line)
    return done


def test_folds_over_lines_against_plain_ones(spark):
    rng = random.Random(3)
    texts = ["", "\n", "\n\n", "x" * 20, "x" * 20 + "\n", "\n" + "x" * 20 + "\n\n" + "y" * 20, "RESULTS", "a\nRESULTS\nAbstract\nb", None]
    texts += ["\n".join(rng.choice(["", " ", "a", "bb c", "RESULTS", "Abstract ", "结论", "x" * rng.randrange(25)]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", chunking.pack_default(F.col("text"), 10).alias("lines"), chunking.academic_sections(F.col("text")).alias("sections")).collect():
        assert r.lines == (None if r.text is None else packed_lines(r.text, 10)), r.text
        assert r.sections == (None if r.text is None else paper_sections(r.text)), r.text
