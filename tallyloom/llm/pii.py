"""Surrogates for personal data and credentials, in DataFrame operations only.

Entities are found by one pattern. Each is a kind and a canonical form (lower case; for numbers, digits alone), so an
entity written in different ways or in many documents is one entity. A keyed hash of the canonical form draws a surrogate
of the same kind and format: letters for letters in their case, digits for digits, hexadecimal for hexadecimal, with
separators, country codes, top-level domains, key names and titles left in place; card numbers keep a valid check digit,
addresses stay addresses, names keep gender and script. A person under several titles has one gender and one surrogate.

Distinct entities keep distinct surrogates, and none becomes an entity of the corpus: over all distinct entities,
surrogates that collide are drawn again until none does. All others follow from the hash alone, so texts are rewritten
where they lie; only entities drawn again have to be looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name, row_hash, settle

KEY = "change this key"
# Draws that keep the format; later ones grow by a few characters, so distinct surrogates never run out.
SHORT_DRAWS = 8

# What the kinds look like (Java patterns), in the order in which they are tried.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа", "госпожа"),
    "n": ("Dr", "Prof"),
}
TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\.? "
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# A capitalised word with its hyphenated and apostrophe parts, an initial, or letters of a script without case. Whatever
# repeats is a single class or possessive, so that matching takes neither a stack nor another try.
PART = r"(?:(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:[-‐'’]\p{L}+)*+|\p{Lu}\.(?:-?\p{Lu}\.)*+|\p{Lo}[\p{Lo}\p{M}]*+)"
PARTICLE = "(?:(?:van|von|vom|zu|zum|zur|de|del|della|der|den|des|di|da|do|dos|du|la|le|ten|ter|bin|al|el) )"
# Words that are written with a capital in headings and begin no part of a name: a name ends before them.
HEADING = (
    "A An And As At But By For From If In Into Is Of On Or The To With Was Were Who Has Had Have Will Would Can Could Not No "
    "His Her Its Our Their This That These Those Are Be Been After Before About Against Between During Over Under Until Upon "
    "Annual Report Reports Board Show Meeting Minutes Letter Letters Story Interview Speech Statement Review Summary News Update "
    "Office Department Committee Company Council Court Hospital School University Institute Church Center Centre Hall Street "
    "Road Avenue Square Chapter Section Part Page Book Film Song Album Series Award Prize Act Bill Case Law Rule Plan Project "
    "Said Says Met Meets Visits Visited Wins Won Opens Opened Joins Joined Leaves Left Takes Took Gets Got Makes Made Goes Went "
    "Und Oder Der Die Das Ein Eine Im Am Bei Mit Nach Zu Zur Zum Ist War Wird Hat Le La Les Et Ou Un Une Du Des Est Avec Dans "
    "Pour Sur El Los Las Y O En Es Con Por Para"
).split()
END = rf"(?:{'|'.join(HEADING)})(?!['’\p{{L}}-])"
# To the closing quote, past escaped ones; eight characters with a letter or digit at least.
QUOTED = r"{q}(?=(?:[^{q}\r\n]|\\{q}){{8}})(?=[^{q}\r\n]*[\p{{L}}\p{{N}}])[^{q}\r\n]*+(?:(?<=\\){q}[^{q}\r\n]*+)*+{q}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?"
    rf"(?:{QUOTED.format(q='\"')}|{QUOTED.format(q=chr(39))}|(?=\S*[\p{{L}}\p{{N}}])\S{{8,}}+)",
    "access": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+.])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "card": r"(?<![A-Za-z0-9.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9]|\.\d)",
    "person": rf"(?<!\p{{L}}){TITLE}{PARTICLE}*+{PART}(?: (?!{TITLE}|{END}){PARTICLE}*+{PART})*+",
}
PATTERN = "|".join(PATTERNS.values())
# Characters of which every entity but a person has one. Texts without them and without titles are left alone after a
# quick look.
HINT = "[0-9@=:]"

# Given names by gender and script, and surnames: in alphabets two parts, in the others one before the given name.
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Victor"),
    ("f", "latin"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Olivia", "Vera"),
    ("n", "latin"): ("Alex", "Charlie", "Dana", "Eden", "Jamie", "Jules", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni"),
    ("m", "cyrillic"): ("Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег", "Павел", "Юрий"),
    ("f", "cyrillic"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Яна"),
    ("n", "cyrillic"): ("Валя", "Женя", "Саша", "Паша", "Слава", "Тоня"),
    ("m", "greek"): ("Ανδρέας", "Βασίλης", "Δημήτρης", "Ηλίας", "Κώστας", "Λεωνίδας", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία", "Χριστίνα"),
    ("n", "greek"): ("Άλεξ", "Γαβριέλ", "Ραφαέλ", "Σταμ"),
    ("m", "han"): ("伟", "强", "军", "勇", "杰", "涛", "明", "辉", "刚", "峰", "鹏", "磊"),
    ("f", "han"): ("芳", "娜", "敏", "静", "丽", "艳", "娟", "霞", "燕", "玲", "婷", "雪"),
    ("n", "han"): ("文", "华", "平", "林", "云", "宁", "安", "晨", "清", "新", "悦", "然"),
    ("m", "hangul"): ("민준", "서준", "도윤", "예준", "시우", "주원", "하준", "지호", "준서", "건우"),
    ("f", "hangul"): ("서연", "서윤", "지우", "서현", "하은", "하윤", "민서", "지유", "윤서", "채원"),
    ("n", "hangul"): ("지원", "수민", "현수", "은우", "재희", "시현", "유진", "다온"),
}
SURNAME_STARTS = {
    "latin": ("Ash", "Beck", "Corn", "Dal", "East", "Fair", "Green", "Hart", "Kirk", "Lang", "Mar", "North", "Oak", "Red", "Stan", "West"),
    "cyrillic": ("Бел", "Вол", "Гор", "Дуб", "Зим", "Кор", "Лес", "Мор", "Нов", "Остр", "Пол", "Реч", "Сад", "Тих", "Чар", "Яр"),
    "greek": ("Αλεξ", "Βασιλ", "Γεωργ", "Δημητρ", "Ελευθερ", "Θεοδωρ", "Ιωανν", "Καραμαν", "Λαμπρ", "Μανωλ", "Νικολ", "Πετρ", "Σταυρ", "Φωτ"),
    "han": ("王", "李", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "徐", "孙", "胡", "朱", "高", "林"),
    "hangul": ("김", "이", "박", "최", "정", "강", "조", "윤", "장", "임", "한", "오", "서", "신", "권", "황"),
}
SURNAME_ENDS = {
    "latin": ("bach", "berg", "bury", "by", "dale", "field", "ford", "ham", "land", "ley", "man", "more", "son", "ton", "well", "wood"),
    "cyrillic": ("аев", "анов", "арин", "енин", "еров", "иков", "илов", "инин", "овин", "онов", "оров", "очкин", "унин", "уров", "ушин", "яков"),
    "greek": ("άκης", "άδης", "ίδης", "άρης", "έλης", "ώτης", "ίτσης", "άτης"),
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}"}
FEMALE_ENDS = {"cyrillic": ("$", "а"), "greek": ("ς$", "")}  # how a woman's surname differs


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, inside a lambda too."""
    return F.get(F.transform(F.array(value), use), 0)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, parity: Column | int) -> Column:
    """Sum of the digits, those at places of the given parity (from the right, 0 first) doubled and cast out."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == parity, twice).otherwise(digit)

    return F.when(F.length(digits) == 0, 0).otherwise(F.aggregate(places, F.lit(0), add))


def kind_of(match: Column) -> Column:
    """The kind of a match; null for a long number that is no card number."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = match.rlike(f"^(?:{pattern})$")
        if name == "card":
            found = found & (_luhn_sum(_digits(match), 1) % 10 == 0)
        kind = F.when(found, F.lit(name)).otherwise(kind)
    return kind


def _parts(kind: Column, match: Column) -> Column:
    """head, body, tail: what is kept, replaced, kept."""
    cut = {
        "email": r"^()(.*)(\.[A-Za-z]+)$",
        "secret": r"(?s)^([A-Za-z_-]+ ?[=:] ?[\"']?)(.*)()$",
        "access": r"^(AKIA)(.*)()$",
        "phone": r"^(.*?)((?:\d[^0-9]*){10}|(?:\d[^0-9]*){6,9})()$",
        "card": r"^(\d)(.*)(\d)$",
        "person": rf"^({TITLE})(.*)()$",
    }

    def group(n: int) -> Column:
        part = match if n == 2 else F.lit("")
        for name, pattern in cut.items():
            part = F.when(kind == name, F.regexp_extract(match, pattern, n)).otherwise(part)
        return part

    def parts(whole: Column) -> Column:
        # Punctuation behind a secret stays.
        body = F.when(kind == "secret", F.rtrim(whole, F.lit("\"'.,;:)]}>"))).otherwise(whole)
        tail = F.when(kind == "secret", F.substr(whole, F.char_length(body) + 1)).otherwise(group(3))
        return F.struct(group(1).alias("head"), body.alias("body"), tail.alias("tail"))

    return _let(group(2), parts)


def entity_of(match: Column) -> Column:
    """kind, head, body, tail and the canonical form of a match."""

    return _let(kind_of(match), lambda kind: _entity(kind, match))


def _entity(kind: Column, match: Column) -> Column:
    """entity_of for a match of a known kind."""

    def name(parts: Column) -> Column:
        numeric = kind.isin("phone", "ssn")
        whole = F.when(kind == "card", _digits(match)).when(numeric, _digits(parts["body"]))
        whole = whole.when(kind.isin("secret", "access"), parts["body"]).otherwise(F.lower(parts["body"]))
        return F.struct(
            kind.alias("kind"), parts["head"].alias("head"), parts["body"].alias("body"), parts["tail"].alias("tail"),
            whole.alias("canonical"),
        )

    return _let(_parts(kind, match), name)


def gender_of(head: Column) -> Column:
    """m, f or n by the title in a person's head; n for all other heads."""
    title = F.regexp_replace(head, r"\.? $", "")
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")


def _draw(digest: Column, place: Column | int, choices: Column | int) -> Column:
    """A number below `choices` (at most 256) from the digest's byte of that place; later places use the bytes again."""
    place = F.lit(place) if isinstance(place, int) else place
    byte = F.conv(F.substring(digest, 2 * (place % 64) + 1, F.lit(2)), 16, 10).cast("int")
    return (byte + F.floor(place / 64).cast("int") * 31) % choices


def _letter(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at + 1, F.lit(1))


def _poured(kind: Column, body: Column, digest: Column) -> Column:
    """The body with its letters and digits replaced. Numbers are written in several ways, so their digits are counted; all
    else draws by the place in the body, which takes time in proportion to it.
    """
    counted = kind.isin("phone", "ssn", "card")

    def number(state: Column, c: Column) -> Column:
        n, is_digit = state["n"], c.between("0", "9")
        # Area and exchange codes start at 2.
        leading = (kind == "phone") & n.isin(0, 3)
        digit = F.when(leading, 2 + _draw(digest, n, 8)).otherwise(_draw(digest, n, 10)).cast("string")
        return F.struct(F.concat(state["out"], F.when(is_digit, digit).otherwise(c)).alias("out"), (n + is_digit.cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    numbers = F.aggregate(F.split(body, ""), start, number, lambda state: state["out"])

    def letters(choices: Column) -> Column:
        def replaced(c: Column, n: Column) -> Column:
            digit = _draw(digest, n, 10).cast("string")
            lower = _letter("abcdefghijklmnopqrstuvwxyz", _draw(digest, n, choices))
            new = F.when(c.between("0", "9"), digit).when(c.between("a", "z"), lower).when(c.between("A", "Z"), F.upper(lower))
            # Letters and digits of other scripts, which a secret may hold.
            other = F.when(c.rlike(r"\p{Lu}"), F.upper(lower)).when(c.rlike(r"\p{L}"), lower).when(c.rlike(r"\p{N}"), digit).otherwise(c)
            return F.when(c <= "\x7f", F.coalesce(new, c)).otherwise(other)

        return F.array_join(F.transform(F.split(body, ""), replaced), "")

    hexadecimal = (kind == "secret") & body.rlike("^[0-9a-fA-F]+$")
    return F.when(counted, numbers).otherwise(_let(F.when(hexadecimal, 6).otherwise(26), letters))


def _name(gender: Column, body: Column, digest: Column) -> Column:
    """A given name (if the body has two words or more) and a surname, of the gender and the name's script."""
    scripts = list(SURNAME_STARTS)
    parted, female = body.contains(" "), gender == "f"
    number = F.lit(scripts.index("latin"))
    for script, letters in SCRIPTS.items():
        number = F.when(body.rlike(letters), scripts.index(script)).otherwise(number)
    by_gender = [F.array(*[F.lit(list(GIVEN[g, script])) for g in ("m", "f", "n")]) for script in scripts]
    starts = [F.lit(list(SURNAME_STARTS[script])) for script in scripts]
    ends = [F.lit(list(SURNAME_ENDS.get(script, ("",)))) for script in scripts]
    one_of = lambda values, place: F.get(values, _draw(digest, place, F.size(values)))

    def build(n: Column) -> Column:
        given = F.get(F.get(F.array(*by_gender), n), F.when(gender == "m", 0).when(female, 1).otherwise(2))
        surname = F.concat(one_of(F.get(F.array(*starts), n), 1), one_of(F.get(F.array(*ends), n), 2))
        for script, (end, instead) in FEMALE_ENDS.items():
            surname = F.when(female & (n == scripts.index(script)), F.regexp_replace(surname, end, instead)).otherwise(surname)
        between = F.when(parted, " ").otherwise("")
        second = F.when(n == scripts.index("han"), one_of(given, 2)).otherwise("")
        surname_first = F.concat(surname, between, one_of(given, 0), second)
        given_first = F.concat(F.when(parted, one_of(given, 0)).otherwise(""), between, surname)
        return F.when(n.isin(*[scripts.index(x) for x in scripts if x not in SURNAME_ENDS]), surname_first).otherwise(given_first)

    name = _let(number, build)
    cased = body.rlike(r"\p{Lu}\p{Lu}") & (body == F.upper(body))
    return F.when(cased, F.upper(name)).otherwise(name)


def _address(body: Column, digest: Column) -> Column:
    """A private address keeps its network; other addresses get a public first part."""
    octet = lambda i, n, low=0: (low + _draw(digest, i, n)).cast("string")
    parts = F.split(body, r"\.")
    public = octet(0, 116, 11)  # 11 to 126
    first = F.when(parts[0].isin("10", "127"), parts[0])
    two = (F.concat(parts[0], F.lit("."), parts[1]) == "192.168") | body.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\.")
    first = first.when(two, parts[0]).otherwise(public)
    second = F.when(two, parts[1]).otherwise(octet(1, 256))
    return F.concat_ws(".", first, second, octet(2, 256), octet(3, 254, 1))


def surrogate(entity: Column, attempt: Column, key: str = KEY, gender: Column | None = None) -> Column:
    """The surrogate text of an entity (see entity_of): keyed by kind, canonical form and attempt alone. A person's gender
    is that of the title unless given.
    """
    gender = gender_of(entity["head"]) if gender is None else gender
    kind = entity["kind"]
    message = F.concat_ws("\x1f", F.lit(key), kind, entity["canonical"], attempt.cast("string"))
    # The key encloses the message twice, as in HMAC.
    digest = F.sha2(F.concat(F.lit(key + "\x1e"), F.sha2(message, 512)), 512)

    def build(h: Column) -> Column:
        head, body, tail = entity["head"], entity["body"], entity["tail"]
        poured = _let(_poured(kind, body, h), lambda p: _card(head, p).when(kind != "card", F.concat(head, p, tail)))
        text = F.when(kind == "person", F.concat(head, _name(gender, body, h)))
        text = text.when(kind == "ip", _address(body, h)).otherwise(poured)
        longer = F.substring(h, F.lit(100), F.least(attempt - SHORT_DRAWS + 2, F.lit(28)))
        return F.when(attempt < SHORT_DRAWS, text).otherwise(F.concat(text, F.lit("-"), longer))

    def _card(head: Column, body: Column) -> Column:
        # The digits before the check digit: the one next to it is doubled.
        total = _luhn_sum(F.concat(_digits(head), _digits(body)), 0)
        return F.when(kind == "card", F.concat(head, body, ((10 - total % 10) % 10).cast("string")))

    return _let(digest, build)


def matches(text: Column) -> Column:
    """All matches in a text, in order."""
    none = F.array().cast("array<string>")
    hint = text.rlike(HINT)
    for title in (t for titles in TITLES.values() for t in titles):
        hint = hint | text.contains(f"{title} ") | text.contains(f"{title}. ")
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def redrawn(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """(kind, canonical, attempt, gender): the entities of docs whose first surrogate collides, with the attempt that
    doesn't, and the persons seen under titles of different gender. A person's gender is the one that the titles tell; n
    if they tell none or both.

    Works on the distinct entities of all texts. A round draws for the entities that are open; of those that draw the same
    the one with the smallest canonical form keeps it, unless an earlier round gave it away or it is an entity itself.
    """
    found = docs.select(F.explode(matches(F.col(text))).alias("m")).select(entity_of(F.col("m")).alias("e"))
    found = found.where("e.kind is not null").groupBy("e.kind", "e.canonical")
    told = F.array_sort(F.collect_set(gender_of(F.col("e.head"))))
    entities = found.agg(F.min("e").alias("e"), told.alias("told"))
    either = F.array_remove("told", "n")
    gender = F.when(F.size(either) == 1, either[0]).otherwise("n")
    entities = settle(entities.select("kind", "canonical", "e", gender.alias("gender"), (F.size("told") > 1).alias("mixed")), "pii-entities")
    taken = entities.select("kind", F.col("canonical").alias("made"))
    open_ones, attempt, more = entities, 0, []
    while True:
        drawn = settle(open_ones.withColumn("made", surrogate(F.col("e"), F.lit(attempt), key, F.col("gender"))), "pii-drawn")
        # Compared in canonical form: heads and separators don't make a surrogate distinct.
        drawn = drawn.withColumn("made", _entity(F.col("kind"), F.col("made"))["canonical"])
        free = drawn.join(taken, ["kind", "made"], "left_anti")
        first = free.groupBy("kind", "made").agg(F.min("canonical").alias("canonical"))
        kept = settle(first.withColumn("attempt", F.lit(attempt)), "pii-kept")
        taken = taken.unionByName(kept.select("kind", "made"))
        known = entities.where(F.lit(attempt > 0) | F.col("mixed")).select("kind", "canonical", "gender")
        more.append(kept.join(known, ["kind", "canonical"]).select("kind", "canonical", "attempt", "gender"))
        open_ones = settle(open_ones.join(kept, ["kind", "canonical"], "left_anti"), "pii-open")
        if open_ones.isEmpty():
            break
        attempt += 1
    result = more[0]
    for part in more[1:]:
        result = result.unionByName(part)
    return result


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity in the text replaced; optionally their number as a column `count` (long).

    Texts without entities are unchanged, null stays null, empty stays empty; rows, repeats included, and all other columns
    are kept. Surrogates follow from the key and the set of entities in docs: reruns agree.
    """
    exceptions = settle(redrawn(docs, key, text), "pii-redrawn")
    found, row, drawn = (free_name(docs, n) for n in ("_matches", "_row", "_attempts"))
    marked = docs.withColumn(found, matches(F.col(text)))
    made_of = lambda e: surrogate(e, F.lit(0), key)
    if not exceptions.isEmpty():
        # Rows that hold such an entity get a small map of them; text is only shuffled if there are too many to broadcast.
        marked = marked.withColumn(row, row_hash(docs, *docs.columns))
        name = lambda e: F.concat_ws("\x1f", e["kind"], e["canonical"])
        held = marked.select(row, F.explode(found).alias("m")).select(row, entity_of(F.col("m")).alias("e"))
        held = held.select(row, "e.kind", "e.canonical").distinct().join(exceptions, ["kind", "canonical"])
        entry = F.struct(F.concat_ws("\x1f", "kind", "canonical").alias("key"), F.struct("attempt", "gender").alias("value"))
        held = held.groupBy(row).agg(F.map_from_entries(F.collect_list(entry)).alias(drawn))
        marked = marked.join(held, row, "left")

        def made_of(e: Column) -> Column:
            own = lambda d: surrogate(e, F.coalesce(d["attempt"], F.lit(0)), key, F.coalesce(d["gender"], gender_of(e["head"])))
            return _let(F.try_element_at(F.col(drawn), name(e)), own)

    def new(match: Column) -> Column:
        return _let(entity_of(match), lambda e: F.when(e["kind"].isNull(), match).otherwise(made_of(e)))

    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.zip_with(gaps, F.transform(found, new), lambda gap, made: F.concat(gap, F.coalesce(made, F.lit(""))))
    made = F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(F.col(text))
    columns = [made.alias(c) if c == text else F.col(c) for c in docs.columns if c != count]
    if count:
        kinds = F.filter(found, lambda m: kind_of(m).isNotNull())
        columns.append(F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias(count))
    return marked.select(*columns)
