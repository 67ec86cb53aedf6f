import re

import pytest

from tallyloom.llm import pii, queries
from tests.conftest import SF_SMALL
from tests.llm.test_text import replaced

# (text, what must be gone)
WHOLE = [
    ("token=aaaaaaaa.bbbbbbbb.cccccccc end", ["aaaaaaaa", "bbbbbbbb", "cccccccc"]),
    ("password=abcdefgh!xyz1 end", ["abcdefgh", "xyz1"]),
    ("password: größe12345 end", ["gr", "öße", "12345"]),
    ('secret = "two words, and\' more9" end', ["two", "words", "more9"]),
    ('secret = "abcdefgh\\"tail1234" end', ["abcdefgh", "tail1234"]),
    ("api_key=" + "Q7" * 5000 + "zzz9 end", ["Q7Q7Q7", "zzz9"]),
    ("Herr Karl Heinz Mueller end", ["Karl", "Heinz", "Mueller"]),
    ("Mr Jean-Luc Picard end", ["Jean", "Luc", "Picard"]),
    ("Mrs O'Brien end", ["Brien"]),
    ("Frau Anna Müller-Lüdenscheidt end", ["Anna", "Müller", "denscheidt"]),
    ("Herr Ludwig van Beethoven end", ["Ludwig", "Beethoven"]),
    ("Mr J. R. Hartley end", ["J. R.", "Hartley"]),
    ("Mr Karl Heinz Otto Emil Mueller end", ["Karl", "Heinz", "Otto", "Emil", "Mueller"]),
    ("Señora María de la Cruz end", ["Mar", "Cruz"]),
    ("Dr Γιώργος Παπαδόπουλος end", ["Γιώργος", "Παπαδόπουλος"]),
    ("Mr. 李 伟 end", ["李", "伟"]),
    ("write to " + "l" * 70 + "@example.org end", ["l" * 6, "example"]),
    ("write to a@b.c-d." + "e" * 70 + ".org end", ["c-d", "e" * 6]),
    ("call 555 123 4567 end", ["555 123 4567", "123 4567"]),
]


def test_no_part_of_an_entity_is_left(spark):
    out, counts = replaced(spark, [t for t, _ in WHOLE])
    for (text, gone), made, n in zip(WHOLE, out, counts):
        assert n == 1 and made.endswith(" end"), (text[:60], made[:60])
        assert not [g for g in gone if g in made], (text[:60], made[:60])


def test_neighbours_of_an_entity_stay(spark):
    texts = ["token=abcdefgh1, then token=abcdefgh1 and more", "password: ******** stays", "Mrs Mary Miller Mr John Smith met"]
    out, counts = replaced(spark, texts)
    first, second = out[0].removesuffix(" and more").split(", then ")
    assert first == second and counts == [2, 0, 2]
    assert out[1] == texts[1] and " Mr " in out[2] and out[2].endswith(" met")


def test_one_name_under_two_titles_is_one_person(spark):
    names = [f"{a}{chr(97 + i % 26)} {b}{chr(97 + i // 26)}" for i in range(26 * 8) for a, b in (("Anna", "Miller"), ("Bert", "Carl"), ("Cleo", "Dent"))]
    rows = [(n, t) for i, n in enumerate(names) for t in (("Dr", "Mrs"), ("Prof", "Mr"), ("Mr", "Mrs"), ("Dr",), ("Ms",))[i % 5]]
    out, counts = replaced(spark, [f"{t} {n}" for n, t in rows])
    assert set(counts) == {1}
    made = {}
    for (name, title), text in zip(rows, out):
        head, _, new = text.partition(" ")
        assert head == title
        made.setdefault(name, set()).add(new)
    assert all(len(found) == 1 for found in made.values())
    new = [min(found) for found in made.values()]
    assert len(set(new)) == len(new) == len(names) and not set(new) & set(names)
    assert min(made[names[0]]).split()[0] in pii.GIVEN["f", "latin"] and min(made[names[1]]).split()[0] in pii.GIVEN["m", "latin"]


def test_names_end_where_a_heading_goes_on(spark):
    cases = {
        "The Letter Mr Smith Sent": ("The Letter Mr ", "Smith", None),
        "met Mr Smith Annual Report Of The Board": ("met Mr ", "Smith", " Annual Report Of The Board"),
        "Dr Jean-Luc Picard Wins The Prize": ("Dr ", "Jean-Luc Picard", " Wins The Prize"),
        "News About Mrs O'Brien In The Hospital": ("News About Mrs ", "O'Brien", " In The Hospital"),
        "Mr J. R. Hartley And The Book": ("Mr ", "J. R. Hartley", " And The Book"),
        "Herr Ludwig van Beethoven Und Die Oper": ("Herr ", "Ludwig van Beethoven", " Und Die Oper"),
        "Dr Who Show": ("Dr ", "Who", " Show"),
        "Mr Book": ("Mr ", "Book", ""),
        "Mr Parton Actman": ("Mr ", "Parton Actman", ""),
    }
    out, counts = replaced(spark, list(cases))
    assert set(counts) == {1}
    for (before, name, after), made in zip(cases.values(), out):
        assert made.startswith(before), made
        assert after is None or made.endswith(after), made
        assert not [w for w in re.split("[ -]", name) if re.search(rf"\b{re.escape(w)}\b", made[len(before) : len(made) - len(after or "")])], made


def test_surrogates_keep_the_script(spark):
    names = ["Mr Γιώργος Παπαδόπουλος", "Mrs Μαρία Λιάπη", "Mr 李 伟", "Ms 王芳", "Mr 김 민수", "Господин Иван Петров", "Mr John Miller", "Mr JOHN MILLER"]
    out, counts = replaced(spark, names)
    assert set(counts) == {1} and len(set(out)) == len(out)
    scripts = [r"[Α-ώΆ-Ώ]+ [Α-ώΆ-Ώ]+ς", r"[Α-ώΆ-Ώ]+ [Α-ώΆ-Ώ]+[^ς]", r"[一-鿿] [一-鿿]{2}", r"[一-鿿]{3}", r"[가-힣] [가-힣]{2}", r"[А-я]+ [А-я]+",
               r"[A-Z][a-z]+ [A-Z][a-z]+", r"[A-Z]+ [A-Z]+"]
    for name, made, script in zip(names, out, scripts):
        title, _, new = made.partition(" ")
        assert title == name.split()[0] and re.fullmatch(script, new), made


MILLION = 1_000_000
LONG = {
    "email labels": "x@" + "a." * (MILLION // 2), "email local": "a" * MILLION + "@example.org", "email ats": "a@" * (MILLION // 2),
    "email dots": "x@" + "." * MILLION, "secret": "token=" + "Ab9" * (MILLION // 3), "quoted": 'token="' + "a b" * (MILLION // 3) + '"',
    "open quote": 'token="' + "a\\" * (MILLION // 2), "punctuation": "token=a" + ")" * MILLION + "a", "access": "AKIA" + "A" * MILLION,
    "phone": "555-" * (MILLION // 4), "plus": "+1 23 " * (MILLION // 6), "ssn": "123-45-" * (MILLION // 7), "card": "1" * MILLION,
    "cards": "4111 1111 " * (MILLION // 10), "ip": "1." * (MILLION // 2), "person": "Mr " + "Anna " * (MILLION // 5),
    "hyphens": "Mr Anna" + "-Anna" * (MILLION // 5), "initials": "Mr " + "J." * (MILLION // 2), "particles": "Mr " + "van " * (MILLION // 4),
    "titles": "Mr " * (MILLION // 3), "han": "Mr " + "李" * MILLION, "blanks": " " * MILLION, "keys": "token=" * (MILLION // 6),
}


def test_very_long_texts_of_every_kind(spark):
    out, _ = replaced(spark, list(LONG.values()))
    made = dict(zip(LONG, out))
    assert "Ab9" * 3 not in made["secret"] and len(made["secret"]) == len(LONG["secret"])
    assert "a" * 9 not in made["email local"] and "AnnaAnna" not in made["person"].replace(" ", "")
    for name in ("blanks", "email dots", "access", "card", "ip"):
        assert made[name] == LONG[name]


def plain_entities(text):
    """Planted kinds found without the operator's patterns."""
    found = [("email", m.lower()) for m in re.findall(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", text)]
    found += [("ip", m) for m in re.findall(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", text) if all(int(x) < 256 for x in m.split("."))]
    found += [("ssn", m) for m in re.findall(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", text)]
    return found


def test_table_against_a_plain_reader(spark):
    """One surrogate for one entity over all documents, distinct for distinct ones, none of them an entity of the corpus."""
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF_SMALL, "documents").collect()}
    query = queries.op5_pii(spark, SF_SMALL)
    out = {r.doc_id: r.text or "" for r in query.collect()}
    assert out == {r.doc_id: r.text or "" for r in queries.op5_pii(spark, SF_SMALL).collect()}
    made, corpus = {}, set()
    for doc_id, text in docs.items():
        before, after = plain_entities(text), plain_entities(out[doc_id])
        assert [k for k, _ in before] == [k for k, _ in after]
        corpus.update(before)
        for old, new in zip(before, after):
            assert made.setdefault(old, new) == new
        if not before and not re.search("[0-9=:@]|Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Se|M|Г|г", text):
            assert out[doc_id] == text
    assert made and len(set(made.values())) == len(made) and not set(made.values()) & corpus


@pytest.mark.parametrize("column", ["text", "doc_id"])
def test_null_columns(spark, column):
    rows = [(None if column == "doc_id" else 1, None if column == "text" else "Mr Smith", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _matches string")
    out = pii.replace_entities(docs, count="n").collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["_matches"] == "x" and out[0].n == (column == "doc_id")
