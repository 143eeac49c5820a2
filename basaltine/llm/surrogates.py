"""Personal data replaced by surrogates (native).

Entities are found by one pattern, reduced to a canonical form (an email in lower case, a phone's digits, ...) and each
distinct one gets a surrogate from a keyed digest: of the same kind and format, a name of the same script and gender, a
card number that passes or fails its check digit as the original does. Surrogates are checked against each other and
against all originals of the corpus; where two meet, all but one try the next digest. So different entities stay
different, one entity has one surrogate wherever it comes, and no surrogate is another one's original.

A name is found after a title; then its words are found in the whole text, with a title or without. The entity is the
word: each has one surrogate in the corpus, so a surname agrees with the full name, whatever title stands before it. The
gender of a given name is the one that most of its titles tell.

Only documents with entities are written and shuffled. Entities are distinct before they are checked, and their
surrogates return by a join of written tables, of which Spark can split a hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved

#: Titles that go before a name, by the gender they tell (n: none).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"),
    "n": ("Dr", "Prof"),
}
_ALL_TITLES = sorted((t for group in TITLES.values() for t in group), key=len, reverse=True)
#: A word of a name; a possessive ending is none of it.
_WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))+"
_TITLE = rf"(?:{'|'.join(_ALL_TITLES)})\.? "
_TITLED = rf"(?<!\p{{L}})(?:{_TITLE}){{1,3}}{_WORD}(?: {_WORD}){{0,3}}"
_NOT_HEX = r"(?![:\w]|\.\d)"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The kinds of entities and their patterns, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": rf"{_LABEL}\s{{0,2}}[\"']?[A-Za-z0-9+/_-]{{8,}}",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ipv6": rf"(?<![:.\w])(?=[0-9A-Fa-f:]{{0,36}}\d)(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}{_NOT_HEX}|[0-9A-Fa-f]{{3,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}}::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}})?{_NOT_HEX})",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": _TITLED,
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What any entity needs: a digit, an at sign, a secret's label, a key's prefix or a title. Texts without are left alone at once.
HINT = rf"[\d@]|{_LABEL}|AKIA|ASIA|(?<!\p{{L}}){_TITLE}\p{{Lu}}"
#: The words (in place of %s) of a text's titled names, wherever they stand.
_SAME = rf"(?<![\p{{L}}'’-])(?:%s)(?: (?:%s))*(?!\p{{L}})"
#: Tries for a surrogate that meets no other. After the first PLAIN in the format of the original, each has a longer varying part.
TRIES, PLAIN = 64, 8
_SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "o"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "ий"),
    "greek": ("βγδζθκλμνπρστ", "αεηιο", "α", "ος"),
}


def _kind(raw: Column) -> Column:
    known = [F.when(raw.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()]
    return F.coalesce(*known, F.when(raw.rlike(rf"^{_WORD}(?: {_WORD})*$"), F.lit("name")), F.lit("card"))


def _words(kind: Column, raw: Column) -> Column:
    """array<struct<lead, value, title>>: the parts of a match that are replaced, what stays before each, and the title.

    A secret's label stays and so does a name's title; every word of a name is a part.
    """
    title = F.regexp_extract(raw, rf"^((?:{_TITLE}){{0,3}})", 1)
    names = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
    secret = F.regexp_extract(raw, r"([A-Za-z0-9+/_-]+)$", 1)
    of_name = F.transform(names, lambda w, i: F.struct(F.when(i == 0, title).otherwise(F.lit(" ")).alias("lead"), w.alias("value"), title.alias("title")))
    value = F.when(kind == "secret", secret).otherwise(raw)
    lead = F.substring(raw, F.lit(1), F.length(raw) - F.length(value))
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(lead.alias("lead"), value.alias("value"), F.lit("").alias("title"))))


def _gender(kind: Column, title: Column, given: Column) -> Column:
    """What a title tells of the given names after it (f or m); empty where there is no title, and of a surname."""
    female, male = (title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(TITLES[g])})(?!\p{{L}})") for g in "fm")
    told = F.when(female, F.lit("f")).when(male, F.lit("m")).otherwise(F.lit(""))
    return F.when((kind == "name") & given, told).otherwise(F.lit(""))


def _canon(kind: Column, value: Column) -> Column:
    """What stays the same when an entity is written in another way."""
    return F.when(kind.isin("email", "name", "ipv6"), F.lower(value)).when(kind.isin("phone", "card"), F.regexp_replace(value, r"\D", "")).otherwise(value)


def _stream(key: str, *parts: Column, chars: Column) -> Column:
    """Two hex digits for each of some characters."""
    blocks = F.sequence(F.lit(0), F.floor((chars - 1) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", F.lit(key), *parts, b.cast("string")), 512)), "")


def _number(stream: Column, at: Column | int) -> Column:
    """The byte at a place of the stream."""
    start = at * 2 + 1 if isinstance(at, Column) else F.lit(at * 2 + 1)
    return F.conv(F.substring(stream, start, F.lit(2)), 16, 10).cast("int")


def _one_of(letters: Column | str, number: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, (number % F.length(letters) + 1).cast("int"), F.lit(1))


def _in_format(value: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters of their case; hexadecimal stays so; all else stays."""
    is_hex = value.rlike("^[0-9a-f]+$")

    def other(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return (
            F.when((c >= "0") & (c <= "9"), _one_of("0123456789", n))
            .when((c >= "a") & (c <= "z"), F.when(is_hex, _one_of("abcdef", n)).otherwise(_one_of("abcdefghijklmnopqrstuvwxyz", n)))
            .when((c >= "A") & (c <= "Z"), _one_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{L}"), _one_of("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _longer(attempt: Column) -> Column:
    """1, 2, ...: the characters by which an attempt is longer than the original."""
    return F.slice(F.sequence(F.lit(1), F.lit(24)), 1, F.least(F.greatest(attempt - PLAIN + 1, F.lit(0)), F.lit(24)))


def _email(canon: Column, stream: Column, more: Column) -> Column:
    """Another local part and other labels but the last, under a domain that is reserved for examples."""
    local, domain = F.substring_index(canon, "@", 1), F.split(F.substring_index(canon, "@", -1), r"\.")
    inner = F.array_join(F.slice(domain, 1, F.size(domain) - 1), ".")
    ours = _in_format(F.concat(local, F.lit("@"), inner), stream)
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _number(stream, 63) % 3 + 1)
    return F.concat(F.substring_index(ours, "@", 1), more, F.lit("@"), F.substring_index(ours, "@", -1), F.lit(".example."), top)


def _card(canon: Column, stream: Column, more: Column) -> Column:
    """Another number with the same first digit that passes or fails the check-digit test as this one does."""
    body = F.concat(F.substring(canon, 1, 1), _in_format(F.substring(canon, F.lit(2), F.length(canon) - 2), stream), more)
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda n: F.call_function("luhn_check", n) == F.call_function("luhn_check", canon))
    return F.get(fits, 0)


def _six(stream: Column) -> Column:
    """A private address of version 6."""
    return F.concat(F.lit("fd"), F.substring(stream, 1, 2), *[x for k in range(7) for x in (F.lit(":"), F.substring(stream, 3 + 4 * k, 4))])


def _ip(stream: Column, attempt: Column) -> Column:
    """An address of the private block 10.0.0.0/8; where those run out, a private one of version 6."""
    four = F.concat(F.lit("10."), _number(stream, 0), F.lit("."), _number(stream, 1), F.lit("."), _number(stream, 2))
    return F.when(attempt < PLAIN, four).otherwise(_six(stream))


def _phone(canon: Column, stream: Column, more: Column) -> Column:
    """The first digit (of the country code) stays."""
    return F.concat(F.substring(canon, 1, 1), _in_format(F.substring(canon, F.lit(2), F.length(canon)), stream), more)


def _name(stream: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """An invented word in the script of the original; a given name of a known gender ends as such names do.

    Attempts after the first PLAIN have more syllables.
    """
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def spoken(consonants: str, vowels: str, female: str, male: str) -> Column:
        base = F.concat(*[x for k in range(3) for x in (_one_of(consonants, _number(stream, 2 * k)), _one_of(vowels, _number(stream, 2 * k + 1)))])
        more = F.transform(_longer(attempt), lambda k: F.concat(_one_of(consonants, _number(stream, 2 * k + 6)), _one_of(vowels, _number(stream, 2 * k + 7))))
        end = F.when(gender == "f", female).when(gender == "m", male).otherwise(F.lit(""))
        return F.concat(base, F.array_join(more, ""), _one_of(consonants, _number(stream, 6)), end)

    return F.coalesce(*[F.when(script == s, spoken(*sounds)) for s, sounds in _SOUNDS.items()])


def _surrogate(key: str) -> Column:
    """The surrogate of (kind, canon, gender) at some attempt, in canonical form."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    stream = _stream(key, kind, canon, attempt.cast("string"), chars=F.greatest(F.length(canon), F.lit(64)))
    rest = _stream(key, kind, canon, attempt.cast("string"), F.lit("longer"), chars=F.lit(64))
    more = lambda letters: F.array_join(F.transform(_longer(attempt), lambda k: _one_of(letters, _number(rest, k))), "")
    digits = more("0123456789")
    return (
        F.when(kind == "email", _email(canon, stream, more("abcdefghijklmnopqrstuvwxyz")))
        .when(kind == "card", _card(canon, stream, digits))
        .when(kind == "ip", _ip(stream, attempt))
        .when(kind == "ipv6", _six(stream))
        .when(kind == "phone", _phone(canon, stream, digits))
        .when(kind == "cloud_key", F.concat(F.substring(canon, 1, 4), _in_format(F.substring(canon, F.lit(5), F.length(canon)), stream)))
        .when(kind == "name", _name(stream, canon, F.col("gender"), attempt))
        .otherwise(F.concat(_in_format(canon, stream), digits))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender), a row a mention or fewer, to the surrogates in canonical form: kind, canon, gender, surrogate.

    There is one row for each (kind, canon), of the gender that most of its rows tell (f of as many f as m). No two
    entities of a kind share a surrogate and none equals an original. Where a format has too few surrogates, the later
    attempts are longer, a digit, letter or syllable each time, so that all get one; RuntimeError after TRIES.
    """
    f, m = (F.count_if(F.col("gender") == g) for g in "fm")
    told = F.when((f == 0) & (m == 0), "").when(f >= m, "f").otherwise("m")
    done, pending = None, saved(entities.groupBy("kind", "canon").agg(told.alias("gender")).withColumn("attempt", F.lit(0)))
    originals = pending.select("kind", F.col("canon").alias("surrogate"))
    for _ in range(TRIES):
        tried = saved(pending.withColumn("surrogate", _surrogate(key)))
        taken = originals if done is None else originals.unionAll(done.select("kind", "surrogate"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        free = saved(first.join(taken, ["kind", "surrogate"], "left_anti"))
        judged = saved(tried.join(free, ["kind", "surrogate"], "left").withColumn("good", F.coalesce(F.col("first") == F.col("canon"), F.lit(False))))
        good = judged.where("good").select("kind", "canon", "gender", "surrogate")
        done = good if done is None else done.unionAll(good)
        pending = judged.where("not good").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done
    raise RuntimeError("no distinct surrogates were found")


def _written(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate as its original was written: digits into their places, upper case and initials as they were."""
    digits = F.split(surrogate, "")
    holes = F.split(value, r"\d", -1)
    spaced = F.array_join(F.zip_with(holes, digits, lambda h, d: F.concat(F.coalesce(h, F.lit("")), F.coalesce(d, F.lit("")))), "")
    upper = F.upper(value) == value
    named = F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate))
    mail = F.when(upper, F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card"), spaced).when(kind == "name", named).when(kind == "email", mail).otherwise(surrogate)


def pattern_of(text: Column) -> Column:
    """The pattern of a text's entities: ``PATTERN``, and the words of its titled names wherever they stand."""
    titled = F.array_join(F.regexp_extract_all(text, F.lit(_TITLED), F.lit(0)), " ")
    bare = F.regexp_replace(titled, rf"(?<!\p{{L}}){_TITLE}", "")
    # longer words first, so that none is cut short
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    either = F.array_join(words, "|")
    return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + "|"), F.replace(F.lit(_SAME), F.lit("%s"), either))).otherwise(F.lit(PATTERN))


def with_surrogates(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its entities replaced, and ``n_entities`` (long) and ``kinds`` (their kinds, sorted, by commas).

    Columns of those two names are replaced; all others are carried along in a struct, so no name clashes. A null text
    stays null and has no entities. Rows that are the same each get the same text; an empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    has = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN), F.lit(False))
    t = F.col("t")
    # only these rows are written and shuffled; their numbers are written with them
    some = docs.where(has).select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in own]).alias("d"), docs[text].alias("t"))
    some = some.select("row", "d", "t", pattern_of(t).alias("p"))
    some = saved(some.select("row", "d", F.regexp_extract_all("t", F.col("p"), F.lit(0)).alias("raws"), F.split(t, F.col("p"), -1).alias("parts")))
    raw, kind = F.col("raw"), F.col("kind")
    each = some.select("row", F.posexplode("raws").alias("at", "raw")).select("row", "at", "raw", _kind(raw).alias("kind"))
    each = each.select("row", "at", "kind", _words(kind, raw).alias("words"))
    each = each.select("row", "at", "kind", F.size("words").alias("n"), F.posexplode("words").alias("w", "x")).select("row", "at", "kind", "n", "w", "x.*")
    mentions = saved(each.select("*", _canon(kind, F.col("value")).alias("canon"), _gender(kind, F.col("title"), F.col("w") < F.col("n") - 1).alias("gender")).drop("n", "title"))
    known = saved(surrogates(mentions, key))
    new = F.concat("lead", _written(kind, F.col("value"), F.col("surrogate")))
    replaced = mentions.drop("gender").join(known, ["kind", "canon"]).select("row", "kind", "at", "w", new.alias("new"))
    # the words of a match, then the matches of a row
    by_match = replaced.groupBy("row", "at").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("w", "new"))).alias("ws"))
    by_match = by_match.select("row", F.struct("at", F.array_join(F.transform("ws", lambda w: w["new"]), "").alias("new"), "kind").alias("n"))
    by_row = saved(by_match.groupBy("row").agg(F.sort_array(F.collect_list("n")).alias("news")))
    again = F.array_join(F.zip_with("parts", F.col("news.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    columns = [again.alias(c) if c == text else F.col("d").getField(c).alias(c) for c in own]
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("news.kind"))), ",")
    changed = some.join(by_row, "row").select(*columns, F.size("raws").cast("long").alias("n_entities"), kinds.alias("kinds"))
    none = docs.where(~has).select(*own, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return none.unionByName(changed)
