"""PII (operator 6): keyed surrogates of detected entities, consistent in type, format, script and gender.

Entities are e-mail and IP addresses, phone, card and social-security numbers, IBANs, long hexadecimal
secrets, and persons: names after a title, and the same surnames, with or without a given name before
them, elsewhere in the document. Every distinct entity gets one surrogate, a keyed hash of its canonical
form, so the same entity is replaced alike everywhere and in every way of writing it. A person's given
name and surname have surrogates of their own, whatever the title, its full stop and the case, so "Mr.
John Smith", "MR SMITH" and "John Smith" stay one person. Surrogates that meet each other or a real
entity are drawn again. Letters stay letters of their script and case, digits stay digits, separators
stay; card numbers and IBANs that pass their checks get ones that pass; a title's gender chooses the
given name. Every pattern repeats a bounded number of times or without backtracking, so that no text,
however long or odd, exhausts the matcher's stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Titles of women, of men, and of anyone.
WOMEN, MEN, ANYONE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme"), ("Mr", "Herr", "Señor", "Monsieur"), ("Dr", "Prof", "Mx")
TITLE = "(?:" + "|".join(t if t == t.upper() else f"{t}|{t.upper()}" for t in (*WOMEN, *MEN, *ANYONE)) + ")"
#: What counts as an entity, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,126}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE}\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}}+(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}}+)?",
}
#: The characters that an entity of a kind may begin with: at all others the matcher goes on at once.
BEGIN = {"ip": "0-9", "phone": "0-9+(", "ssn": "0-9", "card": "0-9", "iban": "A-Z", "secret": "0-9a-fA-F", "name": "".join(sorted({t[0] for t in (*WOMEN, *MEN, *ANYONE)}))}
ANY = r"(?=[\p{L}\p{N}._%+(-])(?:" + "|".join(f"(?=[{BEGIN[k]}])(?:{p})" if k in BEGIN else f"(?:{p})" for k, p in PATTERNS.items()) + ")"
#: Given names by gender ("u": not known), and the syllables that surnames are made of.
GIVEN = {
    "f": ("Alma", "Britta", "Carla", "Delia", "Edith", "Fiona", "Greta", "Helen", "Irene", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Petra"),
    "m": ("Albert", "Bruno", "Conrad", "Dennis", "Egon", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    "u": ("Alex", "Andrea", "Robin", "Kim", "Sascha", "Toni", "Charlie", "Dominique", "Eden", "Florence", "Jamie", "Jules", "Morgan", "Noel", "Quinn", "Riley"),
}
SYLLABLES = ("bar", "bel", "bin", "bor", "dal", "den", "dor", "fal", "fen", "gar", "gel", "hal", "hol", "kel", "kin", "lan", "len", "lor", "mar", "mel", "mon", "nel", "nor", "pal", "rin", "ros", "sal", "sen", "tal", "ver", "vin", "wel")
#: Letters of a script (a regular expression, tried in order) and what takes their place; the last takes all other letters.
SCRIPTS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[ß-ÿ]", "àáâäçèéêëìíîïñòóôöùúûü"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[а-я]", "абвгдежзийклмнопрстуфхцчшщэюя"),
    (r"\p{IsLatin}", "āăąćčďđēėęěğģīįķļłńňōőŕřśšťūůűźžż"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщэюя"),
    (r"\p{IsHan}", "安白成大东方国海和华金林明南平青山水天文"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보"), (r"\p{IsArabic}", "بتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
)
#: The same for digits: those of a script stay in it, all other numbers become ASCII digits.
DIGITS = (("[0-9]", "0123456789"), ("[٠-٩]", "٠١٢٣٤٥٦٧٨٩"), ("[۰-۹]", "۰۱۲۳۴۵۶۷۸۹"), (r"\p{N}", "0123456789"))
DIGIT_KINDS = ("phone", "ssn", "card")
#: National digits of a phone number; what stands before them is the country and stays.
NATIONAL = 10
ATTEMPTS = 64
#: After so many attempts addresses and names grow by a letter, so short ones cannot run out.
GROW = 4


def kind_of(found: Column) -> Column:
    out = F.lit("name")
    for kind in ("secret", "iban", "card", "ssn", "phone", "ip", "email"):
        out = F.when(F.regexp_like(found, F.lit(f"^(?:{PATTERNS[kind]})$")), F.lit(kind)).otherwise(out)
    return out


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """One form for all ways of writing an entity; names are made of their parts instead."""
    digits = digits_of(value)
    out = F.when(kind == "phone", F.substring(digits, F.greatest(F.length(digits) - NATIONAL + 1, F.lit(1)), F.lit(NATIONAL)))
    return out.when(kind.isin(*DIGIT_KINDS), digits).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(F.lower(value))


def name_parts(value: Column) -> Column:
    """(title with its blank, given, surname, gender) of a name as written; title and given may be empty."""
    title = F.regexp_extract(value, rf"^{TITLE}\.? ", 0)
    words = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    bare = F.regexp_replace(F.lower(title), "[. ]", "")
    gender = F.when(bare.isin(*[t.lower() for t in WOMEN]), F.lit("f")).when(bare.isin(*[t.lower() for t in MEN]), F.lit("m")).otherwise(F.lit("u"))
    return F.struct(title.alias("title"), F.when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise(F.lit("")).alias("given"), F.element_at(words, -1).alias("surname"), gender.alias("gender"))


def possessive_free(word: Column) -> Column:
    """A word of a name without a possessive ending."""
    return F.regexp_replace(word, "['’]s$", "")


def nibble(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i (from 0), 32 places."""
    return F.conv(F.substring(digest, i * 4 % 125 + 1, F.lit(4)), 16, 10).cast("int")


def scrambled(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its script, case and kind."""

    def char(c, i):
        low, n = F.lower(c), nibble(digest, i)
        out = F.when(F.regexp_like(c, F.lit("[0-9]")), (n % 10).cast("string"))
        for pattern, digits in DIGITS[1:]:
            out = out.when(F.regexp_like(c, F.lit(pattern)), F.substring(F.lit(digits), n % 10 + 1, F.lit(1)))
        for pattern, letters in SCRIPTS:
            letter = F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
            out = out.when(F.regexp_like(low, F.lit(pattern)), F.when(low == c, letter).otherwise(F.upper(letter)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check (0 modulo 10: valid)."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )


def mod97(text: Column) -> Column:
    """Remainder modulo 97 of capitals and digits read as IBANs are, letters as 10 to 35."""
    value = lambda c: F.when(F.regexp_like(c, F.lit("[0-9]")), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def surrogate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """The surrogate of a canonical value."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    keep = F.when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    digits = F.concat(F.substring(value, F.lit(1), keep), scrambled(F.substring(value, keep + 1, F.length(value)), digest))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(luhn_sum(value) % 10 == 0, F.concat(body, check)).otherwise(digits)
    ip = F.concat_ws(".", *[(nibble(digest, F.lit(i)) % 223 + 1).cast("string") for i in range(4)])
    tld = F.regexp_extract(value, r"\.[^.]+$", 0)
    more = scrambled(F.lit("x" * (attempt // GROW)), F.sha2(digest, 512))
    address = F.substring(value, F.lit(1), F.length(value) - F.length(tld))
    address = F.when(F.regexp_like(address, F.lit(r"[\p{L}\p{N}]")), address).otherwise(F.regexp_replace(address, "[^@.]", "x"))
    email = F.concat(more, scrambled(address, digest), tld)
    latin = F.regexp_like(value, F.lit(r"^[\p{IsLatin}'’-]+$"))
    one = lambda g, i: F.lower(F.element_at(F.array(*map(F.lit, GIVEN[g])), nibble(digest, F.lit(i)) % len(GIVEN[g]) + 1))
    given = {g: F.concat_ws("-", one(g, 31), *([one(g, 30)] if attempt else [])) for g in GIVEN}
    names = reduce(lambda out, g: out.when(kind == f"given_{g}", F.concat(given[g], more)), GIVEN, F.when(~latin, F.concat(scrambled(value, digest), more)))
    syllable = lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES)), nibble(digest, F.lit(i)) % len(SYLLABLES) + 1)
    name = names.otherwise(F.concat(syllable(1), syllable(2), *([syllable(3)] if attempt else []), more))
    country, bban = F.substring(value, 1, 2), scrambled(F.substring(value, F.lit(5), F.length(value)), digest)
    proof = F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")
    valid = mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    iban = F.when(valid, F.concat(country, proof, bban)).otherwise(F.concat(country, scrambled(F.substring(value, 3, 2), F.sha2(digest, 512)), bban))
    out = F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "secret", F.substring(digest, F.lit(1), F.length(value))).when(kind == "iban", iban).when(kind == "card", card)
    return out.when((kind == "surname") | F.startswith(kind, F.lit("given")), name).otherwise(digits)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, fake): a surrogate for each distinct (kind, canon); none equals another or a real one of its kind.

    An entity's surrogate depends on the key and on itself, and on other entities only if it meets one.
    """
    entities = cut(entities.distinct())
    real, done, open_ = entities.select("kind", F.col("canon").alias("fake")), None, entities
    for attempt in range(ATTEMPTS):
        drawn = open_.withColumn("fake", surrogate(F.col("kind"), F.col("canon"), attempt, key))
        good = drawn.join(real, ["kind", "fake"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "fake"), ["kind", "fake"], "left_anti")
        good = cut(good.groupBy("kind", "fake").agg(F.min("canon").alias("canon")).select("kind", "canon", "fake"))
        done = good if done is None else done.union(good)
        open_ = cut(entities.join(done, ["kind", "canon"], "left_anti"))
        if not open_.take(1):
            return done
    raise ValueError("some entities have no free surrogate")


def cased(word: Column, fake: Column) -> Column:
    """A name's surrogate in the case of the word that it replaces; double names have capitals in both halves."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(fake)).otherwise(F.replace(F.initcap(F.replace(fake, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-")))


def laid_out(kind: Column, value: Column, fake: Column) -> Column:
    """A surrogate in the way of writing of one occurrence; digits before those of the surrogate (a phone's country) stay."""
    lead = F.greatest(F.length(digits_of(value)) - F.length(fake), F.lit(0))
    digit = lambda i: F.length(digits_of(F.substring(value, F.lit(1), i))) - lead
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(F.regexp_like(c, F.lit("[0-9]")) & (digit(i) >= 0), F.substring(fake, digit(i) + 1, F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(fake, F.length(F.regexp_replace(F.substring(value, F.lit(1), i), " ", "")) + 1, F.lit(1)))), "")
    upper = (value == F.upper(value)) & (value != F.lower(value))
    return F.when(kind.isin(*DIGIT_KINDS), filled).when(kind == "iban", spaced).when(upper, F.upper(fake)).otherwise(fake)


def with_persons(busy: DataFrame, text: str, hits: str) -> Column:
    """The document's pattern: all entities, and the surnames of its titled names, with a given name before them or alone."""
    names = F.filter(F.col(hits), lambda h: F.regexp_like(h, F.lit(rf"^{TITLE}\.? ")))
    surnames = F.array_distinct(F.transform(names, lambda h: possessive_free(F.element_at(F.split(h, " "), -1))))
    one = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:\p{Lu}[\p{L}'’-]{1,40}+ )?(?:"), F.array_join(F.transform(surnames, lambda n: F.concat(n, F.lit("|"), F.upper(n))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(surnames) > 0, F.concat(F.lit(ANY + "|"), one)).otherwise(F.lit(ANY))


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity of ``text`` replaced, and the number of them in n_entities.

    ``key`` is the secret that surrogates hang on. Null texts stay null with no entities; all other
    columns stay (a clashing n_entities keeps its name and the new one gets an underscore). Each row is
    treated by itself, so ids may be null or repeat; equal texts get equal results. An empty table gives
    no rows. Texts may have any length. Rows without entities pass straight through; the others are
    written once, cut at their entities, with a number of their own that their surrogates join by.
    """
    count, hits, rid, fakes, parts, cuts = fresh(docs, "n_entities", "hits", "rid", "fakes", "parts", "cuts")
    titles = "|".join(t if t == t.upper() else f"{t}|{t.upper()}" for t in (*WOMEN, *MEN, *ANYONE))
    maybe = F.col(text).rlike(rf"[0-9@]|(?:{titles})\.? ") | F.col(text).rlike("[0-9a-fA-F]{32}")
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn(hits, F.coalesce(found, F.array().cast("array<string>")))
    plain = marked.where(F.size(hits) == 0).withColumn(count, F.lit(0).cast("long")).drop(hits)
    busy = marked.where(F.size(hits) > 0).withColumn(cuts, with_persons(marked, text, hits))
    busy = busy.withColumn(hits, F.when(F.col(cuts) == ANY, F.col(hits)).otherwise(F.regexp_extract_all(F.col(text), F.col(cuts), F.lit(0))))
    busy = cut(busy.withColumn(parts, F.split(F.col(text), F.col(cuts), -1)).withColumn(rid, F.monotonically_increasing_id()).drop(text, cuts))
    seen = busy.select(F.col(rid).alias("rid"), F.posexplode(hits).alias("at", "value")).withColumn("kind", kind_of(F.col("value")))
    named = seen.where("kind = 'name'").withColumn("p", name_parts(F.col("value")))
    # a person's gender, from any title in the document, is the same for all mentions of the given name
    who = named.groupBy("rid", F.lower("p.given").alias("g")).agg(F.min("p.gender").alias("gender")).where("g <> ''").withColumnRenamed("rid", "gr")
    named = named.join(who, (F.col("rid") == F.col("gr")) & (F.lower("p.given") == F.col("g")), "left")
    piece = lambda kind, word: F.struct(kind.alias("kind"), F.lower(possessive_free(word)).alias("canon"), word.alias("value"))
    pieces = F.array(piece(F.concat(F.lit("given_"), F.coalesce("gender", F.lit("u"))), F.col("p.given")), piece(F.lit("surname"), F.col("p.surname")))
    named = named.select("rid", "at", F.col("p.title").alias("title"), F.posexplode(F.filter(pieces, lambda x: x["value"] != "")).alias("n", "x")).select("rid", "at", "title", "n", "x.*")
    plain_ = seen.where("kind <> 'name'").select("rid", "at", F.lit("").alias("title"), F.lit(0).alias("n"), "kind", canonical(F.col("kind"), F.col("value")).alias("canon"), "value")
    seen = cut(plain_.unionByName(named.select(plain_.columns)))
    known = cut(surrogates(seen.select("kind", "canon"), key))
    by = seen.join(known, ["kind", "canon"])
    person = F.startswith("kind", F.lit("given")) | (F.col("kind") == "surname")
    ending = F.substring("value", F.length(possessive_free(F.col("value"))) + 1, F.length("value"))
    new = F.when(person, F.concat(cased(possessive_free(F.col("value")), F.col("fake")), ending)).otherwise(laid_out(F.col("kind"), F.col("value"), F.col("fake")))
    by = by.withColumn("new", new).groupBy("rid", "at").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("n", "new"))).alias("words"))
    by = by.select("rid", "at", F.concat("title", F.array_join(F.col("words.new"), " ")).alias("new"))
    by = by.groupBy(F.col("rid").alias(rid)).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias(fakes))
    joined = F.array_join(F.flatten(F.transform(fakes, lambda x: F.array(F.get(F.col(parts), x["at"]), x["new"]))), "")
    whole = F.concat(joined, F.element_at(parts, -1))
    busy = busy.join(by, rid).withColumn(count, F.size(hits).cast("long")).withColumn(text, whole)
    return plain.unionByName(busy.select(plain.columns))


#: The key of the registered query; a real run brings its own secret.
QUERY_KEY = "key of the registered query"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "n_entities", "text")
