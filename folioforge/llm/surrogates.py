"""Operator 3, surrogates for personal data, with DataFrame functions alone.

Entities (e-mail and IPv4 addresses, phone, card, bank account and social security numbers, names after a title) are found by one
expression and replaced by keyed surrogates of the same type: a digest of key, type and canonical form draws every character,
and letters stay letters of their script and case, digits digits, punctuation, grouping and top-level domain as they are; a
card keeps its first digit and a valid check digit. A person keeps title and form; every word of the name is drawn by
itself, so a surname is the same alone and after a first name; a first name ends as the title's gender asks (a neutral
title asks for none). The same entity gets the same surrogate in every document, however it is written (coreference); no two
entities share one (distinctness).

Distinctness is checked, not assumed: over all distinct entities of the corpus (of persons: the words of names, in each form
that a gender can give them), a surrogate that two would share, or that is itself an entity of the corpus, is drawn again in
further rounds until none clashes; after ``SAME_FORM`` rounds in the same form, the surrogate grows by some characters, so
that rounds end even where a form has fewer values than the corpus entities. A word that is drawn again is so in every name.
Entities are reduced by partial aggregation, so a frequent one is no burden; redrawn ones are few and are joined by the
hash of the text, broadcast only if the pairs of text and entity are counted to be few.

Null text stays null, empty text empty; text without an entity stays as it is. Null or repeated doc_ids don't matter: a row gives
a row. Where two entities would share a surrogate the first by form keeps it. Further columns stay (``pseudonymised``); an
empty table gives an empty one. A text of any length takes time in proportion to it: quantifiers are bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small

DEMO_KEY = "folioforge-demonstration-key"
SAME_FORM = 4
ROUNDS = 40

TITLES_MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "господин")
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "г-жа", "госпожа")
TITLES_NEUTRAL = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Profesora")


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_TITLE = _any_of(TITLES_MALE + TITLES_FEMALE + TITLES_NEUTRAL)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: In order of precedence where two could begin at the same place. Quantifiers are bounded and runs are entered at their
#: start only, so time is linear in the text, whatever it holds.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_%+\-][\p{L}\p{N}._%+\-]{0,63}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "phone": (
        r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){1,5}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
        r"|(?<!\d )[2-9]\d{2} \d{3} \d{4}(?! ?\d)|0\d(?:[ .]\d{2}){4}(?![ .]?\d)|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,4}(?![ \-]?\d))(?![\p{L}\p{N}])"
    ),
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? ){{1,3}}(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}{{1,30}}(?:[ \-]\p{{Lu}}\p{{Ll}}{{1,30}}){{0,2}}(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: documents without it are passed by.
HINT = rf"[@0-9]|(?:{_TITLE})\.? \p{{Lu}}"
_TITLE_HEAD = rf"^(?:(?:{_TITLE})\.? ){{1,3}}"

# Syllables of made-up names by script; endings by gender.
_SYLLABLES = {
    "latin": ("al", "ber", "car", "dan", "el", "fin", "gar", "hel", "il", "jo", "kar", "len", "mar", "nor", "ol", "per", "quin", "ros", "sal", "tor", "ur", "val", "wen", "yor", "zel", "bri", "cle", "dor", "fre", "gil", "lor", "mil"),
    "cyrillic": ("ал", "бор", "вал", "гор", "дан", "ел", "зар", "ил", "кир", "лен", "мар", "ник", "ол", "пет", "ром", "сав", "тим", "ул", "фед", "яр"),
    "greek": ("αλ", "βασ", "γερ", "δημ", "ελ", "ζην", "ηλ", "θεο", "ιω", "κων", "λεω", "μαρ", "νικ", "ολ", "παν", "ραφ", "σωτ", "τιμ", "φιλ", "χαρ"),
}
_ENDINGS = {"latin": ("in", "a"), "cyrillic": ("ин", "ина"), "greek": ("ος", "α")}
#: What the hex digits of a digest become for a character of each kind.
_HEX = "0123456789abcdef"
_DRAWN = {"[0-9]": "0123456789012345", "[A-Za-z]": "aeioubcdlmnprstv", r"\p{IsCyrillic}": "аеиоубвгдклмнрст", r"\p{IsGreek}": "αειουβγδκλμνπρστ", r"\p{IsLatin}": "àáâäèéêëìíòóôùúç"}
_DIGEST = 192


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, r"\D", ""))
    return (
        F.when(match.contains("@"), "email").when(match.rlike(_TITLE_HEAD), "person").when(match.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
        .when(match.rlike(r"^[A-Z]{2}\d"), "iban").when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(match.rlike(r"^[+(]") | (digits < 13) | match.rlike(r"^0\d{2,4}[ /\-]") & (digits == 13), "phone").otherwise("card")
    )


def canonical(kind: Column, match: Column) -> Column:
    """One form for all spellings of an entity but a person's, which is registered by the words of the name."""
    return (
        F.when(kind == "email", F.lower(match)).when(kind.isin("ip", "ssn"), match).when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(match.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(match, r"\D", ""))).otherwise(F.regexp_replace(match, r"\D", ""))
    )


def _digest(key: str, *parts: Column) -> Column:
    """192 hex digits drawn by the key from the parts."""
    return _let(F.concat_ws("\x1f", F.lit(key), *parts), lambda seed: F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(_DIGEST // 64))))


def _number(digest: Column, i: Column | int, most: int) -> Column:
    """A number below most (256 at most) from the digest's byte i."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.pmod(F.conv(F.substr(digest, 2 * F.pmod(i, F.lit(_DIGEST // 2)) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(most))


def _scrambled(text: Column, digest: Column, keep: Column | int = 0) -> Column:
    """Every letter and digit after the first ``keep`` characters drawn anew, of the same script and case; the rest as it is."""

    def drawn(c: Column, i: Column) -> Column:
        h = F.substr(digest, F.pmod(i, F.lit(_DIGEST)) + 1, F.lit(1))
        low = reduce(lambda w, kind: w.when(c.rlike(kind), F.translate(h, _HEX, _DRAWN[kind])), list(_DRAWN)[1:], F.when(c.rlike("[0-9]"), F.translate(h, _HEX, _DRAWN["[0-9]"]))).otherwise(c)
        return F.when(i < keep, c).when(F.lower(c) != c, F.upper(low)).otherwise(low)

    return F.concat_ws("", F.transform(F.split(text, ""), drawn))


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn's sum where places of that parity from the right (the last: 0) are doubled."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == odd, F.translate(c, "0123456789", "0246813579").cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(digits: Column, digest: Column) -> Column:
    def checked(drawn: Column) -> Column:
        body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
        check = F.pmod(F.lit(10) - _luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
        return F.when(_luhn_sum(digits, 1) % 10 == 0, F.concat(body, check)).otherwise(drawn)

    return _let(_scrambled(digits, digest, 1), checked)


def _ip(text: Column, digest: Column) -> Column:
    """Octets with as many digits as before."""
    octet = lambda o, i: F.when(F.length(o) == 1, 1 + _number(digest, i, 9)).when(F.length(o) == 2, 10 + _number(digest, i, 90)).otherwise(100 + _number(digest, i, 155))
    return F.concat_ws(".", F.transform(F.split(text, r"\."), octet))


def _email(text: Column, digest: Column, key: str) -> Column:
    """Local part drawn by the whole address, domain by the domain alone, so that addresses of one house stay together."""
    domain, tail = F.regexp_extract(text, r"@(.*)\.[^.]*$", 1), F.regexp_extract(text, r"\.([^.]*)$", 1)
    return F.concat(_scrambled(F.substring_index(text, "@", 1), digest), F.lit("@"), _let(domain, lambda d: _scrambled(d, _digest(key, F.lit("domain"), d))), F.lit("."), tail)


def _by_script(word: Column, of) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _name(word: Column, digest: Column) -> Column:
    """Four syllables of the word's script, the first letter a capital."""

    def of(script: str) -> Column:
        syllables = F.array(*map(F.lit, _SYLLABLES[script]))
        return F.concat_ws("", F.transform(F.array(*map(F.lit, range(4))), lambda i: F.element_at(syllables, _number(digest, i, len(_SYLLABLES[script])) + 1)))

    return F.initcap(_by_script(word, of))


def _ending(word: Column, gender: Column | str) -> Column:
    """What a first name ends with: by gender (m, f, or none)."""
    gender = F.lit(gender) if isinstance(gender, str) else gender
    return _by_script(word, lambda script: F.when(gender == "f", _ENDINGS[script][1]).when(gender == "m", _ENDINGS[script][0]).otherwise(""))


def gender_of(match: Column) -> Column:
    """m or f of a person by the title, '' if it doesn't tell."""
    has = lambda titles: match.rlike(rf"^(?:(?:{_TITLE})\.? ){{0,2}}(?:{_any_of(titles)})\.? ")
    return F.when(has(TITLES_FEMALE), "f").when(has(TITLES_MALE), "m").otherwise("")


def words_of(match: Column) -> Column:
    """The words of a person's name."""
    return F.split(F.regexp_replace(match, _TITLE_HEAD, ""), r"[ \-]")


def surrogate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical form; of kind ``name``, of a word of a name. All but the key should be plain columns or variables."""

    def base(digest: Column) -> Column:
        return (
            F.when(kind == "email", _email(form, digest, key)).when(kind == "ip", _ip(form, digest)).when(kind == "card", _card(form, digest))
            .when(kind == "name", _name(form, digest)).otherwise(_scrambled(form, digest, F.when(kind == "iban", 2).when(form.startswith("+"), 2).otherwise(0)))
        )

    def grown(made: Column, digest: Column) -> Column:
        """A form that has run out of values grows by some of the digest's characters."""
        more = F.translate(F.substr(digest, F.lit(3), F.greatest(F.lit(0), 2 * (attempt - SAME_FORM + 1))), "abcdef", "012345")
        longer = F.when(kind == "email", F.concat(F.substring_index(made, "@", 1), more, F.lit("@"), F.substring_index(made, "@", -1))).when(kind == "name", F.concat(made, F.translate(more, "0123456789", "aeiouaeiou"))).otherwise(F.concat(made, more))
        return F.when(attempt < SAME_FORM, made).otherwise(longer)

    return _let(_digest(key, kind, form, attempt.cast("string")), lambda d: _let(base(d), lambda made: grown(made, d)))


def _person(match: Column, key: str, attempt_of) -> Column:
    """The match with its titles and separators, every word of the name replaced."""

    def put(words: Column, separators: Column, gender: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            made = _let(attempt_of(F.lit("name"), w), lambda attempt: surrogate(key, F.lit("name"), w, attempt))
            last = F.when((i == 0) & (F.size(words) > 1), _ending(w, gender)).otherwise("")
            return F.concat(made, last, F.coalesce(F.get(separators, i), F.lit("")))

        return F.concat_ws("", F.transform(words, one))

    bare = F.regexp_replace(match, _TITLE_HEAD, "")
    return F.concat(F.regexp_extract(match, _TITLE_HEAD, 0), _let(bare, lambda name: put(F.split(name, r"[ \-]"), F.regexp_extract_all(name, F.lit(r"[ \-]"), F.lit(0)), gender_of(match))))


def _cased(match: Column, made: Column) -> Column:
    """Capitals where the match has them; what is longer stays small."""
    at = F.split(match, "")
    up = lambda c, i: F.when(F.coalesce(F.lower(F.get(at, i)) != F.get(at, i), F.lit(False)), F.upper(c)).otherwise(c)
    return F.concat_ws("", F.transform(F.split(made, ""), up))


def _slotted(match: Column, bare: Column) -> Column:
    """Letters and digits of bare in the places of the match's; what is longer follows at the end."""
    return F.aggregate(
        F.split(match, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.struct(F.concat(a["out"], F.when(c.rlike("[0-9A-Za-z]"), F.substr(bare, a["at"], F.lit(1))).otherwise(c)).alias("out"), (a["at"] + c.rlike("[0-9A-Za-z]").cast("int")).alias("at")),
        lambda a: F.concat(a["out"], F.substr(bare, a["at"], F.greatest(F.lit(0), F.length(bare) - a["at"] + 1))),
    )


def spelled(kind: Column, match: Column, made: Column) -> Column:
    """The canonical surrogate in the spelling of the match: its capitals, separators and grouping."""
    part = lambda x, i: F.substring_index(x, "@", i)
    return (
        F.when(kind == "email", F.concat(_cased(part(match, 1), part(made, 1)), F.lit("@"), _cased(part(match, -1), part(made, -1)))).when(kind == "ip", made)
        .otherwise(_let(F.regexp_replace(made, r"[^0-9A-Za-z]", ""), lambda bare: _slotted(match, bare)))
    )


def matches(text: Column) -> Column:
    """All entities of a text in order; empty for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def forms_of(match: Column) -> Column:
    """(kind, form) of what a match is registered as: itself, or the words of a person's name."""
    one = lambda kind, form: F.struct(kind.alias("kind"), form.alias("form"))
    return _let(kind_of(match), lambda kind: F.when(kind == "person", F.transform(words_of(match), lambda w: one(F.lit("name"), w))).otherwise(F.array(one(kind, canonical(kind, match)))))


def entities(docs: DataFrame) -> DataFrame:
    """kind, form, n: the distinct entities of all texts (persons: the words of their names) and how often they occur."""
    found = docs.select(F.explode(matches(F.col("text"))).alias("m")).select(F.explode(forms_of(F.col("m"))).alias("f"))
    return found.groupBy("f.kind", "f.form").agg(F.count(F.lit(1)).alias("n"))


def drawn(forms: DataFrame, key: str, attempt: int) -> DataFrame:
    """kind, form, made: every form with its surrogates of that attempt: of a word of a name one for each gender and none."""
    made = forms.select("kind", "form", surrogate(key, F.col("kind"), F.col("form"), F.lit(attempt)).alias("made"))
    endings = F.when(F.col("kind") == "name", F.array(F.lit(""), *(_ending(F.col("form"), g) for g in "mf"))).otherwise(F.array(F.lit("")))
    return made.select("kind", "form", F.explode(F.transform(endings, lambda e: F.concat("made", e))).alias("made"))


def redrawn(known: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, form, attempt of the entities whose first surrogate clashes. known: cut, as entities() gives it."""
    real = known.select("kind", F.col("form").alias("made"))

    def clashing(tried: DataFrame, taken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(what may be kept; the forms that must draw again): a form keeps its surrogates if it is the first with all of them."""
        first = tried.groupBy("kind", "made").agg(F.min("form").alias("form")).join(real if taken is None else real.unionAll(taken), ["kind", "made"], "left_anti")
        lost = cut(tried.join(first, ["kind", "made", "form"], "left_anti").select("kind", "form").distinct())
        return cut(tried.join(lost, ["kind", "form"], "left_anti")), lost

    fine, again = clashing(cut(drawn(known, key, 0)), None)
    kept, out = [fine.select("kind", "made")], []
    attempt = 0
    while not again.isEmpty():
        attempt += 1
        if attempt > rounds:
            raise RuntimeError(f"surrogates still clash after {rounds} rounds")
        settled, again = clashing(cut(drawn(again, key, attempt)), reduce(DataFrame.unionAll, kept))
        kept.append(settled.select("kind", "made"))
        out.append(settled.select("kind", "form", F.lit(attempt).alias("attempt")).distinct())
    return reduce(DataFrame.unionAll, out) if out else known.limit(0).select("kind", "form", F.lit(0).alias("attempt"))


def _replaced(text: Column, found: Column, attempts: Column | None, key: str) -> Column:
    """The text with every match put in its surrogate's place. attempts: a map from kind and form to the round, if any clash."""

    def attempt_of(kind: Column, form: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", kind, form)), F.lit(0))

    def put(m: Column) -> Column:
        made = lambda kind, form: _let(attempt_of(kind, form), lambda attempt: _let(surrogate(key, kind, form, attempt), lambda made: spelled(kind, m, made)))
        return _let(kind_of(m), lambda kind: F.when(kind == "person", _person(m, key, attempt_of)).otherwise(_let(canonical(kind, m), lambda form: made(kind, form))))

    between = F.split(text, ANY, -1)
    parts = F.zip_with(between, F.transform(found, put), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.concat_ws("", parts)).otherwise(text)


def pseudonymised(docs: DataFrame, key: str = DEMO_KEY, counts: bool = False) -> DataFrame:
    """The documents, all columns, with surrogates in ``text``; with counts also a map pii_counts of entities by kind."""
    found, marks, mark = "__pii_found", "__pii_attempts", "__pii_text"
    again = cut(redrawn(cut(entities(docs)), key))
    seen = docs.withColumn(found, matches(F.col("text")))
    attempts = None
    if not again.isEmpty():
        # Which redrawn entities a text holds, by the text's hash; most texts hold none.
        each = docs.select(F.xxhash64("text").alias(mark), F.explode(matches(F.col("text"))).alias("m")).select(mark, F.explode(forms_of(F.col("m"))).alias("f")).select(mark, "f.kind", "f.form").distinct()
        held = cut(each.join(small(again), ["kind", "form"]))
        by_text = held.groupBy(mark).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "form"), "attempt"))).alias(marks))
        # Broadcast by the number of its entries (a short form each), not of its texts.
        by_text = F.broadcast(by_text) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by_text
        seen = seen.withColumn(mark, F.xxhash64("text")).join(by_text, mark, "left")
        attempts = F.col(marks)
    kinds = "__pii_kinds"
    if counts:
        seen = seen.withColumn(kinds, F.transform(F.col(found), kind_of))
    tally = [F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.array(*(F.size(kinds) - F.size(F.array_remove(kinds, x)) for x in PATTERNS))).alias("pii_counts")] if counts else []
    return seen.select(*(_replaced(F.col("text"), F.col(found), attempts, key).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *tally)


def find_and_replace(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """doc_id, text with surrogates, and the number of entities of each kind."""
    out = pseudonymised(docs.select("doc_id", "text"), key, counts=True)
    return out.select("doc_id", "text", *(F.col("pii_counts")[k].cast("bigint").alias(f"n_{k}") for k in PATTERNS))
