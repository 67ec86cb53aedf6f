import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fim, queries
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, form int, extra string"


def plain_version(doc_id, text, unit="line", rate=100, spm=50):
    """By regular expression and code points alone."""
    units = re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(count):
    draw = random.Random(5)
    letters = "ab \n\n\r\x00é£ÿĀ߿ࠀ日本￿😀𐍈<>PSM"
    return ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(count)]


def test_positions_convert_both_ways():
    for text in [*random_texts(200), "", "plain", "😀" * 1000, "a" * 1000 + "é"]:
        data, index, at = text.encode(), fim.Exceptions(text.encode()), 0
        for i, c in enumerate(text + "x"):
            assert (index.byte(i), index.char(at)) == (at, i)
            at += len(c.encode())
        assert len(index.at_char) == sum(len(c.encode()) > 1 for c in text) and index.byte(len(text)) == len(data)


@pytest.mark.parametrize("unit", ["line", "char"])
def test_cuts_equal_plain_ones(unit):
    plan = fim.Plan(unit=unit, rate=80, spm=30)
    for i, text in enumerate(random_texts(400)):
        *numbers, output = plan.make(i, text.encode())
        assert (*numbers, output.decode()) == plain_version(i, text, unit, 80, 30)


def test_odd_rows(spark):
    rows = [(None, "a\nb", 1, "x"), (1, None, 2, None), (2, "", 3, "y"), (3, "a <S> b\nc", 4, "z"), (4, "no break", 5, "z")]
    rows += [(5, "same\nrow\n", 6, "r")] * 3 + [(6, "é\n" * 300_000 + "日" * 200_000, 7, "long")]
    rows += [(i, t, 8, "random") for i, t in enumerate(random_texts(50), 10)]
    made = fim.transform(spark.createDataFrame(rows, SCHEMA))
    assert made.columns == ["doc_id", "text", "extra", *fim.COLUMNS]
    found = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text or "")
        assert r.again == (r.text or "")
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_that_could_be_confused_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.Plan(marks=marks)
    with pytest.raises(ValueError):
        fim.Plan(unit="page")


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF_SMALL, "documents").collect()}
    found = queries.op11_fill_in_middle(spark, SF_SMALL).collect()
    assert {r.doc_id for r in found} == set(docs) and len(found) == len(docs)
    assert {r.form for r in found} == {"psm", "spm"}
    for r in found:
        *numbers, output = plain_version(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == numbers
        assert r.output_sha256 == sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == sha256(docs[r.doc_id].encode()).hexdigest()
