"""PII surrogates, in DataFrame functions alone.

Detected entities get keyed replacements of their own type: digits for digits, letters for letters
in their case, hex for hex, valid addresses and check digits, names of the same gender and script.
An entity is known by its canonical form (case of addresses, separators of numbers, titles and middle
initials of names don't count), so that equal entities agree in all documents; a surname that a text
repeats alone is replaced as in the full name. Surrogates of all entities of the corpus are checked:
where two agree, or one is a real entity, the later one is drawn again.

Names are found by a title, a listed first or family name, or a phrase before them ("my name is");
a name without any of these stays, as do street addresses outside the English order. No pattern
recurses on its input, so texts of any length are safe.

Defined results: null texts stay null and have no entities; empty texts stay empty; texts are taken
whole; repeated rows come back as often as given; other columns are kept, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits, hexdigits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

# Words that tell a name, its gender and its script.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "госпожа"]
TITLES = ["Dr", "Prof"]
MALE = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Paul", "Peter", "Hans", "Jürgen", "Pierre", "Jean", "Carlos", "José", "Antonio"]
FEMALE = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Anna", "Maria", "Laura", "Ursula", "Monika", "Claire", "Sophie", "Carmen", "Lucía", "Elena"]
MORE_MALE = ["Ahmed", "Ali", "Arjun", "Charles", "Christopher", "Edward", "Francesco", "George", "Hiroshi", "Ibrahim", "Joseph", "Kenji", "Klaus", "Luca", "Luis", "Marco", "Mark", "Matthew", "Mohammed", "Omar", "Pablo", "Rahul", "Rajesh", "Stefan", "Stephen", "Steven", "Takashi", "Wolfgang"]
MORE_FEMALE = ["Aisha", "Ana", "Emily", "Emma", "Fatima", "Giulia", "Hannah", "Ingrid", "Isabel", "Jessica", "Julia", "Karen", "Lisa", "Margaret", "Marie", "Nancy", "Olga", "Priya", "Rosa", "Sakura", "Sandra", "Sofia", "Sunita", "Yuki"]
MALE_CYRILLIC = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"]
FEMALE_CYRILLIC = ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"]
FAMILY_FIRST = ["Chen", "Huang", "Kim", "Liu", "Nguyen", "Tran", "Wang", "Yang", "Zhang", "Zhao", "Zhou"]
#: Phrases before a name of one or two words, before one of two words, before a Han name, before a date of birth.
NAME_PHRASES = ["name is", "Name:", "signed by", "Signed by", "ich heiße", "me llamo", "m'appelle", "меня зовут"]
FULL_NAME_PHRASES = ["Dear", "Author:", "Contact:"]
HAN_PHRASES = ["姓名:", "姓名：", "我叫", "名叫"]
BIRTH_PHRASES = ["born on", "Born on", "born", "DOB:", "DOB", "of birth:", "of birth", "geboren am", "née le", "né le", "nacido el", "nacida el"]
STREETS = ["Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Court", "Square"]
SYLLABLES = ["ba", "den", "for", "gar", "hal", "ker", "lin", "mor", "nel", "per", "ros", "sel", "tan", "ver", "wick", "zim"]
SYLLABLES_CYRILLIC = ["ба", "вен", "гор", "дар", "жел", "зим", "кар", "лов", "мир", "нел", "пет", "рос", "сел", "тов", "фед", "шил"]
SURNAMES_HAN = ["王", "李", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "徐", "孙", "朱", "马", "胡", "郭"]
GIVEN_HAN = ["伟", "芳", "娜", "敏", "静", "丽", "强", "磊", "军", "洋", "勇", "艳", "杰", "娟", "涛", "明"]


def _any(words: list[str]) -> str:
    """A pattern for any of the words, by their first letters, so that few alternatives are tried."""
    heads = sorted({w[0] for w in words})
    return "|".join(h + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == h), key=len, reverse=True)) + ")" for h in heads)


_FIRST = _any(MALE + MORE_MALE + FEMALE + MORE_FEMALE + MALE_CYRILLIC + FEMALE_CYRILLIC + FAMILY_FIRST)
_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + TITLES)
_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_LEAD = "|".join(NAME_PHRASES + FULL_NAME_PHRASES)
_DATE = r"(?:\d{4}[-./]\d{2}[-./]\d{2}|\d{2}[-./]\d{2}[-./]\d{4})"


#: Kinds in the order in which they are tried; each pattern matches one entity. Loops over groups are possessive or short, so that none recurses.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9-]++\.))++[A-Za-z]{2,}+",
    "secret": r"(?=[PpSsTtAa])(?<![A-Za-z])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{8,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,128})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f:]{{0,35}}\d|[0-9A-Fa-f]{{0,3}}\d[0-9A-Fa-f]{{0,3}}:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "card": r"(?<![0-9])[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![0-9])",
    "birth": rf"(?=[bBDogn])(?<!\p{{L}})(?:{'|'.join(BIRTH_PHRASES)}) {_DATE}(?!\d)",
    "street": rf"(?=\d)(?<![0-9A-Za-z])\d{{1,5}} (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})",
    "name": rf"(?=[\p{{Lu}}гnimsм])(?<!\p{{L}})(?:(?:{_TITLE})\.? {_WORD}(?: (?:\p{{Lu}}\. )?{_WORD})?|(?:{_FIRST}) (?:\p{{Lu}}\. )?{_WORD}|(?:{'|'.join(NAME_PHRASES)}) {_WORD}(?: {_WORD})?|(?:{'|'.join(FULL_NAME_PHRASES)}) {_WORD} {_WORD})(?!\p{{L}})",
    "han": rf"(?=[姓我名])(?:{'|'.join(HAN_PHRASES)})(?:{'|'.join(SURNAMES_HAN)})\p{{IsHan}}{{1,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What most texts with an entity have: a mark, two capitalised words in a row, or a title with a stop.
_HINT = (
    r"[0-9@=]|[\p{Lu}г]\p{L}{1,15}(?::| by|) (?:\p{Lu}\. )?\p{Lu}\p{Ll}|["
    + "".join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES + TITLES}))
    + "](?:"
    + "|".join(sorted({t[1:] for t in MALE_TITLES + FEMALE_TITLES + TITLES}))
    + r")\. \p{Lu}"
)
_SECRET_HEAD = r"^(.*?[=:]\s{0,2}[\"']?)([A-Za-z0-9+/_-]+)$"
#: Draws after which a surrogate of free format is made longer; of a fixed format it is drawn on.
DRAWS = 24
FREE = ["email", "secret", "name", "street"]


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind(entity: Column) -> Column:
    out = F
    for name, p in PATTERNS.items():
        out = out.when(entity.rlike(f"^(?:{p})$"), name)
    return out


def person(entity: Column) -> Column:
    """A name without title, phrase and middle initial."""
    return F.regexp_replace(F.regexp_replace(entity, rf"^(?:(?:{_TITLE})\.?|{_LEAD}) ", ""), r" \p{Lu}\. ", " ")


def canonical(kind_: Column, entity: Column) -> Column:
    """What of an entity counts for its identity."""
    return (
        F.when(kind_ == "email", F.lower(entity))
        .when(kind_ == "secret", F.regexp_extract(entity, _SECRET_HEAD, 2))
        .when(kind_.isin("phone", "ssn", "card", "iban"), F.regexp_replace(entity, "[^0-9A-Z+]", ""))
        .when(kind_ == "ipv6", F.lower(entity))
        .when(kind_ == "birth", F.regexp_extract(entity, _DATE, 0))
        .when(kind_ == "han", F.regexp_replace(entity, "^(?:" + "|".join(HAN_PHRASES) + ")", ""))
        .when(kind_ == "name", F.concat_ws("|", _gender(entity), person(entity)))
        .otherwise(entity)
    )


def _gender(entity: Column) -> Column:
    """f, m, or n where neither title nor first name tells; a lone surname has none."""
    head = F.regexp_replace(entity, r"[. ].*$", "")
    first = F.substring_index(person(entity), " ", 1)
    return (
        F.when(~person(entity).contains(" "), "n")
        .when(first.isin(FEMALE + MORE_FEMALE + FEMALE_CYRILLIC) | head.isin(FEMALE_TITLES), "f")
        .when(first.isin(MALE + MORE_MALE + MALE_CYRILLIC) | head.isin(MALE_TITLES), "m")
        .otherwise("n")
    )


def _same_gender(found: DataFrame) -> DataFrame:
    """found, persons of unknown gender with that of the same name elsewhere, where it is one alone."""
    known = found.where((F.col("kind") == "name") & (F.substring("canon", 1, 1) != "n")).select(F.expr("substr(canon, 3)").alias("_who"), F.substring("canon", 1, 1).alias("g"))
    known = known.groupBy("_who").agg(F.min("g").alias("_g"), F.max("g").alias("_other")).where("_g = _other")
    unknown = (F.col("kind") == "name") & (F.substring("canon", 1, 1) == "n")
    told = found.join(known, unknown & (F.expr("substr(canon, 3)") == F.col("_who")), "left")
    return told.withColumn("canon", F.when(F.col("_g").isNotNull(), F.concat_ws("|", "_g", "_who")).otherwise(F.col("canon"))).select(found.columns)


def _draw(of: str, place: str, below: int | str, key: str) -> str:
    """SQL for a number under `below`, keyed by kind, attempt, a string and a place in it."""
    return f"pmod(cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, kind, attempt, {of}, {place}), 256), 1, 12), 16, 10) as bigint), {below})"


def _array(values: list[str]) -> str:
    return f"array({', '.join(map(_sql, values))})"


def _pick(values: str, many: int | str, of: str, place: str, key: str) -> str:
    """SQL for one of `many` values, which are an array in SQL."""
    return f"element_at({values}, cast({_draw(of, place, many, key)} + 1 as int))"


def _part(value: str, of: str, keep: int | str = 0) -> str:
    return f"named_struct('value', {value}, 'of', {of}, 'keep', {keep})"


def _parts() -> str:
    """SQL for the strings of an entity that are drawn anew, what each draw is keyed by, and the characters that it keeps at the start."""
    keep = "case when kind in ('phone', 'iban') then 2 when kind = 'card' then 1 when kind = 'key' and (canon like 'AKIA%' or canon like 'gh%') then 4 when kind = 'key' and canon like 'sk-%' then 3 else 0 end"
    return f"""case when kind in ('ip', 'birth', 'han', 'name') then null
        when kind = 'email' then array({_part('local', 'canon')}, {_part('host', 'domain')})
        when kind = 'ipv6' then transform(split(canon, ':'), (g, n) -> {_part('g', 'concat(canon, n)')})
        when kind = 'street' then array({_part("substring_index(canon, ' ', 1)", 'canon')})
        else array({_part('canon', 'canon', keep)}) end"""


def _alike(key: str) -> str:
    """SQL for the values of `parts` with letters and digits drawn anew after the first `keep` characters.

    All kinds share this one expression: the driver parses, plans and prints each expression many times.
    """
    hex_ = f"""case when kind in ('key', 'secret', 'ipv6') and p.value rlike '^[0-9a-f]+$' then '{hexdigits[:16]}'
        when kind in ('key', 'secret') and p.value rlike '^[0-9A-F]+$' then '{hexdigits[:10] + hexdigits[16:]}' end"""
    c = "substr(p.value, i, 1)"
    among = f"""case when i <= p.keep then null when instr(p.hex, {c}) > 0 then p.hex
        when {c} between '0' and '9' then '{digits}' when {c} between 'a' and 'z' then '{ascii_lowercase}' when {c} between 'A' and 'Z' then '{ascii_uppercase}' end"""
    told = f"transform(parts, p -> named_struct('value', p.value, 'of', p.of, 'keep', p.keep, 'hex', {hex_}))"
    marked = f"transform(sequence(1, length(p.value)), i -> named_struct('i', i, 'c', {c}, 'among', {among}))"
    drawn = f"transform({marked}, x -> case when x.among is null then x.c else substr(x.among, cast({_draw('p.of', 'x.i', 'length(x.among)', key)} + 1 as int), 1) end)"
    return f"transform({told}, p -> case when length(p.value) = 0 then '' else array_join({drawn}, '') end)"


def _luhn(value: str, upto: str) -> str:
    """SQL for the check sum of value's first `upto` digits, the last of which is next to the check digit."""
    digit = f"cast(substr({value}, i, 1) as int)"
    return f"aggregate(transform(sequence(1, {upto}), i -> case when ({upto} - i) % 2 = 0 then {digit} * 2 - case when {digit} > 4 then 9 else 0 end else {digit} end), 0, (a, x) -> a + x)"


def _surrogates(keys: DataFrame, key: str) -> DataFrame:
    """keys (kind, canon, attempt) with their surrogate in canonical form."""
    rows = keys.withColumn("domain", F.expr("case when kind = 'email' then substring_index(canon, '@', -1) end"))
    tail = F.expr("substring_index(domain, '.', -1)")
    rows = rows.withColumn("tld", tail).withColumn("host", F.expr("substr(domain, 1, length(domain) - length(tld) - 1)")).withColumn("local", F.expr("substr(canon, 1, length(canon) - length(domain) - 1)"))
    rows = rows.withColumn("gender", F.expr("substr(canon, 1, 1)")).withColumn("person", F.expr("substr(canon, 3)"))
    rows = rows.withColumn("last", F.expr("case when kind = 'street' then canon else substring_index(person, ' ', -1) end"))
    rows = rows.withColumn("cyrillic", F.col("last").rlike(r"\p{IsCyrillic}")).withColumn("parts", F.expr(_parts())).withColumn("alike", F.expr(_alike(key))).withColumn("drawn", F.expr("get(alike, 0)"))
    octets = ", ".join(f"1 + {_draw('canon', str(n), 254, key)}" for n in range(4))
    by_gender = (("true", "m", MALE_CYRILLIC), ("true", "f", FEMALE_CYRILLIC), ("true", "n", MALE_CYRILLIC + FEMALE_CYRILLIC), ("false", "m", MALE), ("false", "f", FEMALE), ("false", "n", MALE + FEMALE))
    firsts = "case " + " ".join(f"when kind = 'name' and cyrillic = {c} and gender = '{g}' then {_array(v)}" for c, g, v in by_gender) + " end"
    # a surname depends on the surname alone, so that "Mr. Orr" and "Paul Orr" stay one person; later draws are longer
    syllable = _pick(f"case when cyrillic then {_array(SYLLABLES_CYRILLIC)} else {_array(SYLLABLES)} end", len(SYLLABLES), "last", "i", key)
    lasts = f"case when kind in ('street', 'name') then initcap(array_join(transform(sequence(1, 3 + cast(attempt / 4 as int)), i -> {syllable}), '')) end"
    rows = rows.withColumn("firsts", F.expr(firsts)).withColumn("surname", F.expr(lasts))
    month, day = (f"lpad(cast(1 + {_draw('canon', _sql(n), most, key)} as string), 2, '0')" for n, most in (("month", 12), ("day", 28)))
    made = f"""case kind
        when 'email' then concat(drawn, '@', get(alike, 1), '.', tld)
        when 'ip' then concat_ws('.', {octets})
        when 'birth' then case when canon rlike '^[0-9]{{4}}' then concat(substr(canon, 1, 3), {_draw('canon', '0', 10, key)}, substr(canon, 5, 1), {month}, substr(canon, 8, 1), {day})
            else concat({day}, substr(canon, 3, 1), {month}, substr(canon, 6, 4), {_draw('canon', '0', 10, key)}) end
        when 'street' then concat(1 + {_draw('canon', _sql('number'), 9, key)}, substr(drawn, 2), ' ', surname, ' ', substring_index(canon, ' ', -1))
        when 'han' then concat({_pick(_array(SURNAMES_HAN), len(SURNAMES_HAN), 'canon', '0', key)}, array_join(transform(sequence(2, length(canon)), i -> {_pick(_array(GIVEN_HAN), len(GIVEN_HAN), 'canon', 'i', key)}), ''))
        when 'ipv6' then array_join(alike, ':')
        when 'name' then concat(case when person like '% %' then concat({_pick('firsts', 'size(firsts)', _sql('first') + ', person', '0', key)}, ' ') else '' end, surname)
        when 'card' then case when ({_luhn('canon', 'length(canon) - 1')} + cast(right(canon, 1) as int)) % 10 = 0
            then concat(left(drawn, length(drawn) - 1), cast((10 - {_luhn('drawn', 'length(drawn) - 1')} % 10) % 10 as string)) else drawn end
        else drawn end"""
    longer = F.when((F.col("attempt") >= DRAWS) & F.col("kind").isin(FREE), F.concat(F.col("made"), F.col("attempt").cast("string"))).otherwise(F.col("made"))
    return rows.withColumn("made", F.expr(made)).select("kind", "canon", "attempt", longer.alias("surrogate"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for all distinct entities (kind, canon), no two surrogates of a kind alike.

    Entities that share a surrogate, or whose surrogate is a real entity, are drawn again (all but
    the smallest of a group) until none is left; every round is a partial aggregation and an anti
    join over what is still open. A fixed format whose strings are all real entities is an error.
    """
    real = entities.select(F.col("kind").alias("_kind"), F.expr("case when kind = 'name' then substr(canon, 3) else canon end").alias("_canon"))
    settled, open_, written = None, entities.withColumn("attempt", F.lit(0)), []
    while True:
        # written first: both sides of the next join read it
        drawn = cut(_surrogates(open_, key))
        all_ = drawn.withColumn("fresh", F.lit(True)) if settled is None else drawn.withColumn("fresh", F.lit(True)).unionByName(settled.withColumn("fresh", F.lit(False)))
        # settled rows come first, then the smallest canonical form
        owner = all_.groupBy("kind", "surrogate").agg(F.min(F.struct("fresh", "canon")).alias("o")).select(F.col("kind").alias("_k"), F.col("surrogate").alias("_s"), F.col("o.canon").alias("_o"))
        judged = all_.join(owner, (F.col("kind") == F.col("_k")) & (F.col("surrogate") == F.col("_s")))
        judged = judged.join(real, (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_canon")), "left")
        judged = cut(judged.select("kind", "canon", "attempt", "surrogate", ((F.col("_o") == F.col("canon")) & F.col("_canon").isNull()).alias("ok")).distinct())
        drop(drawn)
        written.append(judged)
        settled = judged.where("ok").drop("ok")
        if judged.where("not ok").isEmpty():
            for w in written[:-1]:
                drop(w)
            return settled.drop("attempt")
        if judged.where(f"not ok and attempt > {40 * DRAWS}").limit(1).count():
            raise ValueError("a format has too few strings for its entities to have distinct surrogates")
        open_ = judged.where("not ok").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))


def _render(kind_: str, entity: str, surrogate: str) -> Column:
    """An entity as written, with its surrogate's characters."""
    by_case = f"array_join(transform(sequence(1, length({entity})), i -> case when substr({entity}, i, 1) between 'A' and 'Z' then upper(substr({surrogate}, i, 1)) else substr({surrogate}, i, 1) end), '')"
    apart = f"""aggregate(sequence(1, length({entity})), named_struct('s', '', 'n', 0),
        (a, i) -> case when substr({entity}, i, 1) rlike '[0-9A-Z+]' then named_struct('s', concat(a.s, substr({surrogate}, a.n + 1, 1)), 'n', a.n + 1)
                       else named_struct('s', concat(a.s, substr({entity}, i, 1)), 'n', a.n) end,
        a -> concat(a.s, substr({surrogate}, a.n + 1)))"""
    title, initial = _sql(rf"^((?:(?:{_TITLE})\.?|{_LEAD}) )?.*$"), _sql(r" \p{Lu}\. ")
    return F.expr(f"""case when {kind_} = 'email' then concat({by_case}, substr({surrogate}, length({entity}) + 1))
        when {kind_} in ('phone', 'ssn', 'card', 'iban') then {apart}
        when {kind_} = 'ipv6' and {entity} rlike '[A-F]' then upper({surrogate})
        when {kind_} = 'birth' then concat(regexp_extract({entity}, '^[^0-9]*', 0), {surrogate})
        when {kind_} = 'han' then concat(left({entity}, length({entity}) - length({surrogate})), {surrogate})
        when {kind_} = 'secret' then concat(regexp_extract({entity}, {_sql(_SECRET_HEAD)}, 1), {surrogate})
        when {kind_} = 'name' then concat(regexp_extract({entity}, {title}, 1), case when {entity} rlike {initial}
            then concat(substring_index({surrogate}, ' ', 1), ' ', left(substring_index({surrogate}, ' ', -1), 1), '. ', substring_index({surrogate}, ' ', -1)) else {surrogate} end)
        else {surrogate} end""")


def may_match(text: Column) -> Column:
    """False only for texts without any entity; plain searches and short patterns spare most texts the long one."""
    phrases = [p + " " for p in NAME_PHRASES if p[0].islower()] + HAN_PHRASES + ["AKIA", "sk-"]
    out = text.rlike(_HINT) | (text.contains(":") & text.rlike(r":\s{0,2}[\"']?[A-Za-z0-9+/_-]{8}")) | (text.contains("_") & text.rlike("gh[pousr]_")) | text.rlike("[a-f]{32}")
    for p in phrases:
        out = out | text.contains(p)
    return F.coalesce(out, F.lit(False))


def matches_of(text: Column, pattern: Column | None = None) -> Column:
    """All that looks like an entity, in order; numbers that only look like cards are among it."""
    return F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def _real(found: DataFrame) -> DataFrame:
    """Without numbers of card length that fail the check sum: they are no cards."""
    check = F.expr(f"({_luhn('canon', 'length(canon) - 1')} + cast(right(canon, 1) as int)) % 10 = 0")
    return found.where((F.col("kind") != "card") | F.when(F.col("kind") == "card", check))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with the entities of text_col replaced by surrogates drawn with the secret key; count_col (if named) tells how many there were.

    Only texts that may have entities go through a join; each is keyed by its digest, so that copies share one row of replacements.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col(text_col)
    may = may_match(text)
    seen = docs.where(may).select(F.sha2(text, 256).alias("h"), F.array_distinct(matches_of(text)).alias("entities")).where(F.size("entities") > 0)
    found = seen.select("h", F.explode("entities").alias("entity")).distinct()
    found = found.withColumn("kind", kind(F.col("entity")))
    found = cut(_same_gender(_real(found.withColumn("canon", canonical(F.col("kind"), F.col("entity"))))))
    table = surrogates(found.select("kind", "canon").distinct(), key)
    pairs = found.join(table, ["kind", "canon"]).select("h", "kind", "entity", _render("kind", "entity", "surrogate").alias("said"))
    last = lambda c: F.substring_index(c, " ", -1)
    one = F.struct("entity", "said", F.lit(False).alias("alone"))
    alone = F.when(F.col("kind") == "name", F.struct(last("entity").alias("entity"), last("said").alias("said"), F.lit(True).alias("alone")))
    pairs = pairs.select("h", F.explode(F.array_compact(F.array(one, alone))).alias("x")).select("h", "x.*").groupBy("h", "entity").agg(F.min("said").alias("said"), F.max("alone").alias("alone"))
    names = [f"{n}_of_pii" for n in ("_h", "_map", "_pattern")]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    h, m, p = names
    # written first: a join over the aggregation's own exchange could not be split where a third of the texts are one text
    surnames = F.array_join(F.sort_array(F.collect_list(F.when(F.col("alone"), F.col("entity"))), asc=False), "|")
    pattern = F.when(surnames == "", F.lit(PATTERN)).otherwise(F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), surnames, F.lit(r")(?!\p{L})")))
    maps = cut(pairs.groupBy(F.col("h").alias(h)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "said"))).alias(m), pattern.alias(p)))
    matches = matches_of(text, F.col(p))
    said = F.transform(matches, lambda e: F.coalesce(F.element_at(F.col(m), e), e))
    pieces = F.split(text, F.col(p), -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, said, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    # rebuilt from the frame's own columns by position, so that none of theirs can clash
    number = F.size(F.filter(matches, lambda e: F.element_at(F.col(m), e).isNotNull()))
    count = [F.when(F.col(m).isNull(), 0).otherwise(number).cast("long").alias(count_col)] if count_col else []
    none = [F.lit(0).cast("long").alias(count_col)] if count_col else []
    mine = docs.where(may).withColumn(h, F.sha2(text, 256)).join(maps, h, "left")
    done = mine.select(*[F.when(F.col(m).isNull(), text).otherwise(whole).alias(c) if c == text_col else F.col(c) for c in docs.columns], *count)
    return done.unionAll(docs.where(~may).select(*docs.columns, *none))
