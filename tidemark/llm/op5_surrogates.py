"""Surrogates for personal data, in DataFrame functions only.

Entities are found with one regular expression over whole texts: mail
addresses, secrets (keys, tokens, passwords), bank accounts, IPv4 addresses,
social security numbers, phone and card numbers, and persons after a title.
Each distinct entity of a type gets one surrogate, drawn from a keyed hash, of
the same kind: a number keeps its digits' layout (a card its first digit and a
valid check digit, an account its country and check digits), an address its
shape, script and top-level domain, a name its script and, by its title, gender.

Secrets are found in any letter case and at any length: hex of 32 digits or more,
keys with a known prefix, and what stands in quotes after a keyword (6 characters or
more; after "password" any).

Coreference: an entity is known by its canonical form (lower-case address or
secret, bare digits, single names), so all its occurrences in the corpus get the same
surrogate, each in the layout of the occurrence; "Ms. Ada Hill" and "Ms. Hill"
share the surname's surrogate.

Distinctness: no two entities of a type share a surrogate, and none gets the
form of an entity that is in the corpus.  Of those that collide the smallest
keeps it; the others draw again (from the fourth draw on, longer forms) until
none is left.

Only texts with a digit, an @, a title, a keyword, a key's prefix or a run of hex
letters are matched (any entity has one).  A private address keeps its block in
its first draws only: a block can have more addresses than there are to draw.  Nothing but entities and the texts that have some is shuffled.  Null and empty texts
stay as they are; repeated rows get equal texts; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Lady", "Госпожа")
MALE = ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "Sir", "Господин")
_KEYWORDS = "token|secret|api[_-]?key"
#: between a keyword and its quoted value, JSON's closing quote included
_IS = r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']"
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"

#: what an entity of each type looks like, and what must not stand around it;
#: the first type that matches at a place wins
FORMS: dict[str, tuple[str, str, str]] = {
    "mail": (r"(?<![\p{L}\p{N}._%+-])",
             r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,5}\.\p{L}{2,24}",
             ""),
    # up to the same quote again, else up to any
    "quoted": (rf"(?<=[\"'])(?:(?<=(?i:password){_IS})|(?<=(?i:{_KEYWORDS}){_IS})(?=(?<=\")[^\"\n]{{6}}|(?<=')[^'\n]{{6}}))",
               r"(?:(?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|[^\"'\n]++(?=[\"']))", ""),
    "secret": (r"(?<![\p{L}\p{N}])",
               r"(?:[0-9a-fA-F]{32,}+|(?i:AKIA[0-9A-Z]{16}|ghp_[0-9A-Z]{36}|sk-[0-9A-Z]{20,}+))",
               r"(?![\p{L}\p{N}])"),
    "account": (r"(?<![\p{L}\p{N}])",
                r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![\p{L}\p{N}])"),
    "ip": (r"(?<![\p{L}\p{N}.])",
           r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
           r"(?!\.?\p{N})(?!\p{L})"),
    "ssn": (r"(?<![\p{L}\p{N}-])", r"\d{3}-\d{2}-\d{4}", r"(?![\p{L}\p{N}-])"),
    "phone": (r"(?<![\p{L}\p{N}])",
              r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
              r"|\+\d{1,3}(?:[ .-]?\d){7,12})", r"(?!\p{N})"),
    "card": (r"(?<![\p{L}\p{N}.+-])", r"\d(?:[ -]?\d){12,18}", r"(?!\p{N})"),
    "person": (r"(?<![\p{L}\p{N}])",
               rf"(?:{'|'.join(MALE[::-1] + FEMALE)})\.? {_NAME}(?: {_NAME}){{0,2}}", ""),
}
#: besides a title, what a text with an entity has; keep it in step with FORMS
SIGNS = rf"[0-9@]|[a-fA-F]{{32}}|(?i:password|{_KEYWORDS}|akia|ghp_|sk-)"
ANY = "|".join(f"(?:{before}{form}{after})" for before, form, after in FORMS.values())
DIGITS = ("ssn", "phone", "card")
BLOCK_DRAWS = 4         # so many draws of a private address stay in its block

#: letters and names to draw from, by script
LETTERS = {"Latin": "àáâäèéêëìíîïòóôöùúûüñç",
           "Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
           "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
           "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Han": "天地人山水火木金土日月星風雲雨雪花鳥魚林",
           "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
           "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ"}
GIVEN = {("Latin", "f"): "Ada Clara Elena Greta Ida Julia Lena Marta Nora Olga Paula Rosa",
         ("Latin", "m"): "Anton Bruno Carl David Emil Felix Georg Hugo Ivo Jonas Karl Leo",
         ("Cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
         ("Cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Максим Олег"}
SYLLABLES = {"Latin": "bar den fil gor hal kem lin mor nev pol rad sel tam vin wes zor",
             "Cyrillic": "бар вол гор дон зим кал лен мир нов пол рад сем тар фед хол яр"}


def _type(raw: Column) -> Column:
    """Type of a matched entity: the first form that it has as a whole."""
    names = [k for k in FORMS if k != "quoted"]
    kind = reduce(lambda c, k: c.when(raw.rlike(f"^(?:{FORMS[k][1]})$"), k),
                  names[1:], F.when(raw.rlike(f"^(?:{FORMS[names[0]][1]})$"), names[0]))
    return kind.otherwise("secret")


def _parts(raw: Column, kind: Column) -> Column:
    """What an entity consists of, to be joined by spaces: raw, type and
    canonical form; a title has no type and stays."""
    def part(raw: Column, kind: Column, canon: Column) -> Column:
        return F.struct(raw.alias("raw"), kind.alias("kind"), canon.alias("canon"))

    words = F.split(raw, " ")
    female = F.regexp_replace(words[0], r"\.$", "").isin(*FEMALE)
    given = F.when(female, "given_f").otherwise("given_m")
    person = F.transform(words, lambda w, i: (
        F.when(i == 0, part(w, F.lit(None).cast("string"), F.lit("")))
        .when(i == F.size(words) - 1, part(w, F.lit("surname"), F.lower(w)))
        .otherwise(part(w, given, F.lower(w)))))
    canon = (F.when(kind.isin("mail", "secret"), F.lower(raw))
             .when(kind == "account", F.regexp_replace(raw, " ", ""))
             .when(kind.isin(*DIGITS), F.regexp_replace(raw, "[^0-9]", ""))
             .otherwise(raw))
    return F.when(kind == "person", person).otherwise(F.array(part(raw, kind, canon)))


def _draw(seed: Column, i: Column, pool: Column) -> Column:
    return F.substring(pool, F.pmod(F.xxhash64(seed, i), F.length(pool)).cast("int") + 1, F.lit(1))


def _other(seed: Column, canon: Column, first: Column, hexadecimal: Column | None = None) -> Column:
    """``canon`` with letters and digits from position ``first`` on drawn anew
    within their class and script."""
    def letter(c: Column, i: Column) -> Column:
        new = (F.when(c.rlike("[0-9]"), _draw(seed, i, F.lit("0123456789")))
               .when(c.rlike("[a-z]"), _draw(seed, i, F.lit("abcdefghijklmnopqrstuvwxyz")))
               .when(c.rlike("[A-Z]"), _draw(seed, i, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))))
        for script, pool in LETTERS.items():
            new = new.when(c.rlike(rf"\p{{Is{script}}}"), _draw(seed, i, F.lit(pool)))
        if hexadecimal is not None:
            new = F.when(hexadecimal, _draw(seed, i, F.lit("0123456789abcdef"))).otherwise(new.otherwise(c))
        else:
            new = new.otherwise(c)
        return F.when(i < first, c).otherwise(new)
    return F.array_join(F.transform(F.split(canon, ""), letter), "")


def _check_digit(body: Column) -> Column:
    """Luhn's digit that makes ``body`` and it valid."""
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: (
        F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
        .otherwise(c.cast("int")))), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _account_digits(country: Column, rest: Column) -> Column:
    """Check digits of an account: 98 less the remainder by 97."""
    whole = F.split(F.concat(rest, country, F.lit("00")), "")
    remainder = F.aggregate(whole, F.lit(0), lambda r, c: F.when(
        c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - remainder).cast("string"), 2, "0")


def _name(seed: Column, canon: Column, kind: Column, attempt: int) -> Column:
    def pick(words: str, salt: int) -> Column:
        pool = words.split()
        return F.array(*map(F.lit, pool))[F.pmod(F.xxhash64(seed, F.lit(salt)),
                                                 F.lit(len(pool))).cast("int")]

    def of(script: str) -> Column:
        more = [pick(SYLLABLES[script], k) for k in range(attempt)]
        surname = F.concat(*(pick(SYLLABLES[script], 100 + k) for k in range(3)), *more)
        return (F.when(kind == "given_f", F.concat(pick(GIVEN[script, "f"], 99), *more))
                .when(kind == "given_m", F.concat(pick(GIVEN[script, "m"], 99), *more))
                .otherwise(surname))
    other = F.concat(_other(seed, canon, F.lit(0)),
                     *([pick(SYLLABLES["Latin"], k) for k in range(attempt - 2)]))
    return F.lower(F.when(canon.rlike(r"^\p{IsCyrillic}"), of("Cyrillic"))
                   .when(canon.rlike(r"^\p{IsLatin}"), of("Latin")).otherwise(other))


def _seeded(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """With what a draw needs once: for each letter it would be quadratic in a
    long secret."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(attempt).cast("string"))
    return entities.select("kind", "canon", F.sha2(seed, 256).alias("seed"),
                           F.col("canon").rlike("^[0-9a-f]+$").alias("hexadecimal"))


def _surrogate(attempt: int) -> Column:
    """A draw for the columns kind, canon, seed and hexadecimal."""
    kind, canon, seed = F.col("kind"), F.col("canon"), F.col("seed")
    longer = [_draw(seed, F.lit(1000 + k), F.lit("0123456789")) for k in range(max(0, attempt - 2))]
    every = _other(seed, canon, F.lit(0))
    # the local part and the domain but for its last label
    mail = F.concat(*longer, _other(seed, F.regexp_replace(canon, r"\.[^.]*$", ""), F.lit(0)),
                    F.regexp_extract(canon, r"(\.[^.]*)$", 1))
    secret = F.concat(_other(seed, canon, F.lit(0), F.col("hexadecimal")), *longer)
    numbers = F.concat(_other(seed, canon, F.lit(1)), *longer)
    body = F.substring(_other(seed, canon, F.lit(1)), F.lit(1), F.length(canon) - 1)
    body = F.concat(body, *longer)
    valid = _check_digit(F.substring(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1)
    card = F.when(valid, F.concat(body, _check_digit(body))).otherwise(numbers)
    country = F.substring(canon, 1, 2)
    rest = F.concat(F.substring(_other(seed, canon, F.lit(4)), F.lit(5), F.length(canon) - 4), *longer)
    account = F.concat(country, _account_digits(country, rest), rest)
    octets = F.split(canon, r"\.")
    private = (F.when(F.lit(attempt >= BLOCK_DRAWS), 0).when(octets[0] == "10", 1)
               .when((octets[0] == "192") & (octets[1] == "168"), 2).otherwise(0))
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(i < private, o).otherwise(
        (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string"))), ".")
    return (F.when(kind == "mail", mail).when(kind == "secret", secret)
            .when(kind == "account", account).when(kind == "ip", ip)
            .when(kind == "card", card).when(kind.isin("ssn", "phone"), numbers)
            .when(kind.isin("given_f", "given_m", "surname"), _name(seed, canon, kind, attempt))
            .otherwise(every))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for the distinct ``entities`` (kind, canon)."""
    originals = entities.select("kind", F.col("canon").alias("surrogate"))
    pending, chosen, attempt = entities, [], 0
    while True:
        drawn = (_seeded(pending, key, attempt).withColumn("surrogate", _surrogate(attempt))
                 .groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
                 .join(originals, ["kind", "surrogate"], "left_anti"))
        for earlier in chosen:
            drawn = drawn.join(earlier, ["kind", "surrogate"], "left_anti")
        chosen.append(written(drawn.select("kind", "canon", "surrogate"), "surrogates"))
        pending = written(pending.join(chosen[-1], ["kind", "canon"], "left_anti"), "pending")
        attempt += 1
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, chosen)


def _rendered(raw: Column, kind: Column, canon: Column, new: Column) -> Column:
    """The surrogate in the layout of the occurrence."""
    def laid_out(skip: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), skip, ""))
        kept = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
            c.rlike(skip), c).otherwise(F.substring(new, before(i) + 1, F.lit(1)))), "")
        return F.concat(kept, F.substring(new, F.length(canon) + 1, F.length(new)))
    cased = F.when(raw == F.upper(raw), F.upper(new)).otherwise(F.initcap(new))
    mail = F.when(raw == F.lower(raw), new).when(raw == F.upper(raw), F.upper(new)).otherwise(
        F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))
    # letter by letter; drawn hex may have letters where the occurrence has digits
    secret = F.when(raw == F.lower(raw), new).when(raw == F.upper(raw), F.upper(new)).otherwise(
        F.array_join(F.zip_with(F.split(raw, ""), F.split(new, ""), lambda r, c: F.when(
            r != F.lower(r), F.upper(c)).otherwise(c)), ""))
    return (F.when(kind.isNull(), raw)
            .when(kind.isin(*DIGITS), laid_out("[^0-9]"))
            .when(kind == "account", laid_out("[^0-9A-Z]"))
            .when(kind == "mail", mail)
            .when(kind == "secret", secret)
            .when(kind.isin("given_f", "given_m", "surname"), cased)
            .otherwise(new))


def replace(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``count``, a column of that
    name with the number of replaced entities."""
    text = F.col("text")
    maybe = text.rlike(SIGNS)
    for title in MALE + FEMALE:
        maybe = maybe | text.contains(title + " ") | text.contains(title + ". ")
    maybe = F.coalesce(maybe, F.lit(False))
    match = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    found = written(
        docs.filter(maybe).select("doc_id", F.xxhash64("text").alias("text_key"), match.alias("raws"))
        .filter(F.size("raws") > 0).dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.posexplode("raws").alias("pos", "raw"))
        .withColumn("parts", _parts(F.col("raw"), _type(F.col("raw"))))
        .select("doc_id", "text_key", "pos", F.posexplode("parts").alias("part", "p"))
        .select("doc_id", "text_key", "pos", "part", "p.raw", "p.kind", "p.canon"), "entities")
    chosen = surrogates(written(found.filter("kind is not null").select("kind", "canon").distinct(),
                                "distinct"), key)
    rendered = (found.join(chosen, ["kind", "canon"], "left")
                .withColumn("new", _rendered(F.col("raw"), F.col("kind"), F.col("canon"),
                                             F.col("surrogate"))))
    whole = rendered.groupBy("doc_id", "text_key", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))),
                                 lambda x: x["new"]), " ").alias("new"))
    news = whole.groupBy(F.col("doc_id").alias("_tidemark_id"), F.col("text_key").alias("_tidemark_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))),
                    lambda x: x["new"]).alias("_tidemark_news"))

    names = docs.columns
    gaps = F.split(text, ANY, -1)
    joined = docs.filter(maybe).join(
        news, F.col("doc_id").eqNullSafe(F.col("_tidemark_id")) & (F.xxhash64("text") == F.col("_tidemark_key")), "left")
    joined = joined.withColumn("_tidemark_gaps", F.when(F.col("_tidemark_news").isNotNull(), gaps))
    new = F.concat(F.col("_tidemark_gaps")[0], F.array_join(F.zip_with(
        F.col("_tidemark_news"), F.slice("_tidemark_gaps", F.lit(2), F.size("_tidemark_news")),
        lambda r, g: F.concat(r, g)), ""))
    changed = joined.withColumn("text", F.coalesce(new, text))
    extra = [F.coalesce(F.size("_tidemark_news"), F.lit(0)).cast("long").alias(count)] if count else []
    same = [F.lit(0).cast("long").alias(count)] if count else []
    if "n_chars" in names:      # the declared length follows the text
        changed = changed.withColumn("n_chars", F.when(
            F.col("_tidemark_news").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*names, *extra).unionByName(docs.filter(~maybe).select(*names, *same))
