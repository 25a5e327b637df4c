"""PII surrogates: keyed, type-consistent replacements, with DataFrame operations only.

Entities are found by patterns and reduced to a canonical form, so that mentions that differ in
case or punctuation are one entity. Each distinct entity of the corpus gets a surrogate made from a
keyed hash in its own format: letters for letters of the same script, digits for digits,
hexadecimal for keys and addresses, octets for IPv4, valid check digits for cards and IBANs, and
for names syllables of the same script. Gender is an attribute of a first name, not part of its
key: known names have theirs, others the one that most of their titles show. Surrogates that clash
with each other or with a real entity are made again, so different entities stay different and
every mention of one entity gets the same surrogate, in the mention's own case and punctuation.

A name is found by its title, by a known first name, or as two capitalised words beside a word
that speaks of a person (``wrote``, ``Dear``, ``Author:``); the same words are then replaced wherever
else they stand alone with a capital in that text. Double names are replaced part by part.

Nothing in clear is left behind: texts with entities, mentions and the table of surrogates are
written to the shared folder only while a call runs, unless the caller asks for the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import held_once, materialise, scratch

#: Titles that show a gender, and first names that do.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
OTHER_TITLES = "Dr|Prof"
MALE_NAMES = "John James Robert Michael William David Thomas Peter Paul Hans Karl Klaus Jean Pierre Luc Juan Carlos José Luis Иван Пётр Γιώργος".split()
FEMALE_NAMES = "Mary Anna Elizabeth Sarah Laura Julia Emma Sophie Marie Claire Ingrid Greta Carmen María Lucía Elena Анна Мария Ελένη".split()

#: Syllables of surrogate names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha ka ke la le lo ma me mo na ne no pa ra re ro sa se so ta te va".split(),
    "cyrillic": "ба бе бо да де до фа фе га ге ха ка ке ла ле ло ма ме мо на не но па ра ре ро са се со та те ва".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γε χα κα κε λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε ζα".split(),
}
ENDINGS = {
    "latin": {"male": "n", "female": "lia", "other": "ris", "surname": "mer"},
    "cyrillic": {"male": "н", "female": "лия", "other": "рис", "surname": "мер"},
    "greek": {"male": "ν", "female": "λια", "other": "ρις", "surname": "μερ"},
}

#: Letters of a script, for surrogates that keep their layout.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES}"
TITLE = rf"(?:{TITLES})(?![\p{{L}}])\.?[ ]"
WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Verbs after a person's name, words before one, and capitalised words that start a sentence rather than a name.
SPEECH = "wrote|writes|said|says|asked|asks|replied|told|added|lives|lived|works|worked|called|emailed|signed|schrieb|sagte|fragte|antwortete|wohnt|arbeitet|écrit|déclare|demande|habite|travaille|dijo|escribió|preguntó|respondió|vive|trabaja|написал|написала|сказал|сказала|спросил|спросила|ответил|ответила|είπε|έγραψε|ρώτησε|απάντησε"
HERALDS = "Dear|Hello|Hi|named|name is|by|contact|Contact|Author:|From:|To:|Cc:|Name:|Attn:|Regards,|regards,|Liebe|Lieber|Hallo|heißt|Cher|Chère|Bonjour|Querido|Querida|Hola"
NO_NAMES = "The|A|An|This|That|These|Those|My|Our|Your|His|Her|Their|Its|In|On|At|As|And|But|For|From|If|When|Then|All|No|One|We|They|He|She|It|I|Der|Die|Das|Ein|Eine|Und|Le|La|Les|Un|Une|Des|Et|El|Los|Las|Una|Y"
#: A label of a secret and what stands between them; the secret itself is replaced, the label stays.
LABEL = r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|api[ _-]?key|access[ _-]?key|auth[ _-]?token|token|credential|passwort|contraseña|mot de passe|пароль)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?"
#: Kinds of entities and their patterns, in order: of those that match at a place the first counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})*\.\p{L}{2,24}",
    "token": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35}|sk-[A-Za-z0-9_-]{20,128}|xox[abprs]-[A-Za-z0-9-]{10,128}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,2000})(?![A-Za-z0-9_-])",
    "credential": rf"(?<![\p{{L}}\p{{N}}]){LABEL}(?!AKIA|gh[pousr]_|AIza|sk-|xox|eyJ|[0-9a-fA-F]{{32}})(?=(?:[^\s\"',;<>&\p{{L}}\p{{N}}]{{0,20}}[\p{{L}}\p{{N}}]){{4}})[^\s\"',;<>&]{{3,127}}[^\s\"',;<>&.)]",
    "secret": r"\b(?=[0-9a-fA-F]{32})(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]{0,38}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){2,6})(?![\p{L}\p{N}:])",
    "phone": r"\+(?=(?:[ .()/-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ ./-]?[0-9]{2,4}){2,5}\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "local phone": r"(?<![\p{L}\p{N}.,+-])(?:(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{6,8}|0[1-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -][0-9]{3,4}|[679][0-9]{2}(?:[ ][0-9]{2}){3}|[679][0-9]{2}(?:[ ][0-9]{3}){2})(?![\p{N}-])",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "name": rf"(?=\p{{Lu}})\b(?:{TITLE}{WORD}(?:[ ]{WORD})?|(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)})[ ]{WORD}|(?!(?:{NO_NAMES})\b){WORD}[ ]{WORD}(?=[ ](?:{SPEECH})\b)|(?<=\b(?:{HERALDS})[ ])(?!(?:{NO_NAMES})\b){WORD}[ ]{WORD})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: All but names have one of these in them; most texts have none, which is quickly seen.
MARK = "[@0-9_]|AKIA|AIza|sk-|xox|eyJ|(?i:pass|pwd|secret|key|token|credential|contraseña|пароль)[^:=\n]{0,12}[:=]"
MARKED = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "name")
#: In texts with names every other capitalised word is looked at too.
ENTITY_OR_WORD = rf"{ENTITY}|(?:\b{WORD})"


def has_entity(text: Column) -> Column:
    """Whether ``ENTITY`` is found in a text; null texts have none."""
    return F.coalesce((text.rlike(MARK) & text.rlike(MARKED)) | text.rlike(PATTERNS["name"]), F.lit(False))


def mentions(text: Column, pattern: str = ENTITY) -> Column:
    return F.coalesce(F.regexp_extract_all(text.cast("string"), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The kind of a mention; ``word`` for a capitalised word that is no entity by itself."""
    out = F.lit("word")
    for kind, pattern in reversed(PATTERNS.items()):
        # A name may be known by what stood beside it, so two words are one; other capitalised words come singly.
        pattern = rf"{pattern}|{WORD}[ ]{WORD}" if kind == "name" else pattern
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def name_words(mention: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.regexp_replace(mention, f"^{TITLE}", ""), " ")


def parts(mention: Column, kind: Column) -> Column:
    """The entities of a mention in order, as (part, kind, canon, gender, sure); parts of one letter are none.

    Names and words are cut at hyphens and apostrophes. Of a name with two words the first is a
    first name, the last a surname. One word after a title is a surname too, but not for ``sure``:
    the text may know it as a first name. A word's kind is left open (null).
    """

    def entity(i: Column, of: Column, canon: Column, gender: Column, sure: Column = F.lit(True)) -> Column:
        return F.struct(i.cast("int").alias("part"), of.cast("string").alias("kind"), canon.alias("canon"), gender.cast("string").alias("gender"), sure.alias("sure"))

    none = F.lit(None)
    words = name_words(mention)
    title = F.regexp_extract(mention, rf"^({TITLES})(?![\p{{L}}])\.?[ ]", 1)
    gender = F.when(title.rlike(f"^(?:{FEMALE_TITLES})$"), "female").when(title.rlike(f"^(?:{MALE_TITLES})$"), "male")

    def pieces(word: Column, first: int, of: str | None, shown: Column, sure: bool = True) -> Column:
        kind_of_piece = (lambda p: F.concat(F.lit(f"{of}:"), script_of(p))) if of else (lambda p: none)
        return F.transform(F.split(word, "['’-]"), lambda p, i: entity(F.lit(first) + i, kind_of_piece(p), F.lower(p), shown, F.lit(sure)))

    last = F.element_at(words, -1)
    known = words[0].isin(MALE_NAMES + FEMALE_NAMES)
    alone = F.when(known, pieces(last, 100, "first", gender)).otherwise(pieces(last, 100, "surname", gender, False))
    name = F.when(F.size(words) > 1, F.concat(pieces(words[0], 0, "first", gender), pieces(last, 100, "surname", none))).otherwise(alone)
    digits = F.regexp_replace(mention, "[^0-9]", "")
    canon = F.when(kind.isin("phone", "local phone", "card", "ssn"), digits).when(kind == "token", mention).when(kind == "credential", F.regexp_replace(mention, f"^{LABEL}", "")).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(F.lower(mention))
    single = F.array(entity(F.lit(0), F.when(kind == "local phone", "phone").otherwise(kind), canon, none))
    found = F.when(kind == "name", name).when(kind == "word", pieces(mention, 100, None, none)).otherwise(single)
    return F.filter(found, lambda e: F.length(e["canon"]) > 1)


def _stream(key: str, attempt: int) -> Column:
    """256 hexadecimal digits that depend on the key, the entity and the attempt."""
    base = F.concat_ws("|", F.lit(key), F.lit(str(attempt)), "kind", "canon")
    return F.concat(*(F.sha2(F.concat(base, F.lit(f"|{i}")), 512) for i in range(2)))


def _number(stream: Column, i: Column, modulus: int) -> Column:
    """The i-th number below ``modulus`` (i from 0, wrapping round the stream)."""
    return (F.conv(F.substring(stream, i % 64 * 4 + 1, F.lit(4)), 16, 10).cast("int") % modulus).cast("int")


def _spell(like: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """``like`` with each digit and letter replaced by another of its class, case and script."""

    def pick(pool: str, i: Column) -> Column:
        return F.substring(F.lit(pool), _number(stream, i, len(pool)) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef", i)).otherwise(c)
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), pick(LETTERS["cyrillic"], i)).when(c.rlike(r"\p{IsGreek}"), pick(LETTERS["greek"], i)).otherwise(pick(LETTERS["latin"], i))
        return F.when(c.rlike(r"\p{N}"), pick("0123456789", i)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(like, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit that completes ``digits`` (without it)."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number: 98 less its number modulo 97, letters counting from ten."""
    chars = F.split(F.concat(rest, country, F.lit("00")), "")
    value = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.lpad((F.lit(98) - F.aggregate(value, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)).cast("string"), 2, "0")


def candidate(stream: Column, attempt: int) -> Column:
    """Surrogate in canonical form for columns ``kind``, ``canon`` and ``gender``."""
    s, kind, canon = stream, F.col("kind"), F.col("canon")
    local, domain, top = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1), F.substring_index(canon, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_spell(local, s), F.lit("@"), _spell(host, F.reverse(s)), top)
    octets = F.concat_ws(".", *((_number(s, F.lit(i), 254) + 1).cast("string") for i in range(4)))
    front = F.substring(canon, 1, 15)
    checked = F.call_function("luhn_check", canon)
    card = held_once(_spell(front, s), lambda body: F.concat(body, F.when(checked, _luhn(body)).otherwise(F.substring(F.lit("0123456789"), _number(s, F.lit(20), 10) + 1, F.lit(1)))))
    country, rest = F.substring(canon, 1, 2), F.substring(canon, F.lit(5), F.length(canon))
    iban = held_once(_spell(rest, s), lambda r: F.concat(country, F.when(_iban_check(country, rest) == F.substring(canon, 3, 2), _iban_check(country, r)).otherwise(_spell(F.substring(canon, 3, 2), F.reverse(s))), r))
    kept = F.when(F.startswith(canon, F.lit("0")), 1).otherwise(F.greatest(F.lit(0), F.least(F.length(canon) - 10, F.lit(3))))  # country code, or the zero in front
    phone = F.concat(F.substring(canon, F.lit(1), kept), _spell(F.substring(canon, kept + 1, F.length(canon)), s))
    prefix = F.regexp_extract(canon, "^(AKIA|gh[pousr]_|AIza|sk-|xox[abprs]-|eyJ)", 1)
    token = F.concat(prefix, _spell(F.substring(canon, F.length(prefix) + 1, F.length(canon)), s))
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        pool = F.array(*(F.lit(x) for x in syllables))
        stem = F.concat(*(F.element_at(pool, _number(s, F.lit(i), len(syllables)) + 1) for i in range(3 + attempt // 2)))
        for role, end in ENDINGS[script].items():
            own = (kind == f"surname:{script}") if role == "surname" else (kind == f"first:{script}") & (F.col("gender") == role)
            name = F.when(own, F.concat(stem, F.lit(end))).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
        .when(kind.isin("secret", "ipv6"), _spell(canon, s, True)).when(kind == "ssn", _spell(canon, s)).when(kind == "token", token).when(kind == "credential", _spell(F.concat(canon, F.lit("x" * (attempt // 4))), s)).otherwise(name)
    )


def surrogates(entities: DataFrame, key: str, known: DataFrame | None = None, max_attempts: int = 40) -> DataFrame:
    """(kind, canon, surrogate) for entities (kind, canon, gender), one to one within each kind.

    Which of two clashing entities tries again depends on what else the corpus holds, so a grown
    corpus may change a few old replacements. Give the table of an earlier run as ``known``
    (kind, canon, surrogate) and its entities keep theirs.

    A candidate is taken by the smallest entity that got it, unless it is a real entity of the
    kind or was taken before; the rest try again with the next attempt's hash, names with one more
    syllable every other time, labelled secrets with one more letter every fourth. Entities that find no free surrogate in ``max_attempts`` raise an error.
    """
    shown = entities.groupBy("kind", "canon").agg(F.count_if(F.col("gender") == "male").alias("m"), F.count_if(F.col("gender") == "female").alias("f"))
    male, female = ([n.lower() for n in names] for names in (MALE_NAMES, FEMALE_NAMES))
    gender = F.when(F.col("canon").isin(male), "male").when(F.col("canon").isin(female), "female").when(F.col("m") > F.col("f"), "male").when(F.col("f") > 0, "female").otherwise("other")
    real = materialise(shown.select("kind", "canon", gender.alias("gender")), "entities")
    left, done = real, []
    if known is not None:
        done = [known.select("kind", "canon", "surrogate")]
        left = real.join(known, ["kind", "canon"], "left_anti")
    for attempt in range(max_attempts):
        tried = left.withColumn("surrogate", held_once(_stream(key, attempt), lambda s: candidate(s, attempt)))
        free = tried.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        for d in done:
            free = free.join(d.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        taken = materialise(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "surrogates")
        done.append(taken)
        left = materialise(left.join(taken, ["kind", "canon"], "left_anti"), "left")
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"entities without a free surrogate after {max_attempts} attempts")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _in_case(word: Column, like: Column) -> Column:
    """``word`` in capitals, or with a capital, as ``like`` has it."""
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).when(F.substring(like, 1, 1) == F.upper(F.substring(like, 1, 1)), F.initcap(word)).otherwise(word)


def _render(mention: Column, kind: Column, got: Column) -> Column:
    """A mention with its surrogates in its own layout; ``got`` maps parts to surrogates."""
    one = F.element_at(got, F.lit(0))

    def same_case(c: Column, i: Column) -> Column:
        new = F.substring(one, i + 1, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    digits = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(one, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
    )["out"]
    spaced = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c != " ", F.struct(F.concat(a["out"], F.substring(one, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
    )["out"]

    def word(w: Column, first: Column) -> Column:
        marks = F.regexp_extract_all(w, F.lit("['’-]"), F.lit(0))
        pieces = F.transform(F.split(w, "['’-]"), lambda p, i: F.coalesce(_in_case(F.element_at(got, (first + i).cast("int")), p), p))
        return F.array_join(F.zip_with(pieces, marks, lambda p, mark: F.concat(p, F.coalesce(mark, F.lit("")))), "")

    words = name_words(mention)
    named = F.array_join(F.transform(words, lambda w, i: word(w, F.when((i == 0) & (F.size(words) > 1), 0).otherwise(100))), " ")
    name = F.concat(F.regexp_extract(mention, f"^{TITLE}", 0), named)
    labelled = F.concat(F.regexp_extract(mention, f"^{LABEL}", 0), one)
    return (
        F.when(kind == "credential", labelled).when(kind == "name", name).when(kind == "word", word(mention, F.lit(100))).when(kind.isin("phone", "local phone", "card", "ssn"), digits).when(kind == "iban", spaced)
        .when(kind.isin("email", "secret", "ipv6"), F.array_join(F.transform(F.split(mention, ""), same_case), "")).otherwise(one)
    )


def anonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None, table_path: str | None = None) -> DataFrame:
    """``docs`` with entities replaced in the text, and ``n_entities`` (replaced mentions) added.

    Null texts stay null, texts without mentions pass unchanged and are not shuffled; the others
    meet their surrogates by a key of id and text, so rows that repeat both get the same text. An
    empty table gives an empty result. A column named ``n_entities`` is replaced, all others stay.

    Only the replaced texts stay in the shared folder. The table of surrogates is a key to them: it
    is written to ``table_path`` if the caller names one, and taken as ``known`` by a later run.
    """
    with scratch(docs.sparkSession):
        return _anonymise(docs, key, id_col, text_col, known, table_path)


def _anonymise(docs: DataFrame, key: str, id_col: str, text_col: str, known: DataFrame | None, table_path: str | None) -> DataFrame:
    kept = [c for c in docs.columns if c not in (text_col, "n_entities")]
    text = F.col(text_col).cast("string")
    pure = docs.filter(~has_entity(text))
    keys = F.xxhash64(F.struct(F.col(id_col).alias("i"), text.alias("t"))).alias("k"), F.xxhash64(F.lit("second"), text).alias("l")
    own = materialise(docs.filter(has_entity(text)).select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row") if kept else F.lit(1).alias("row"), text.alias("text"), *keys), "texts-with-entities")
    named = F.col("text").rlike(PATTERNS["name"])
    cut = own.select("k", "l", F.when(named, mentions(F.col("text"), ENTITY_OR_WORD)).otherwise(mentions(F.col("text"))).alias("m")).dropDuplicates(["k", "l"])
    each = cut.select("k", "l", F.posexplode("m").alias("pos", "mention")).withColumn("of", kind_of(F.col("mention")))
    each = materialise(each, "mentions")
    pieces = each.select("k", "l", "pos", "of", F.explode(parts(F.col("mention"), F.col("of"))).alias("e")).select("k", "l", "pos", "of", "e.*")
    # A word alone, or after a title, stands for a name of the same text: a surname rather than a first name.
    names = pieces.filter("of = 'name' and sure").groupBy("k", "l", "canon").agg(F.max("kind").alias("known"))
    titled = pieces.filter("of = 'name' and not sure").groupBy("k", "l", "canon").agg(F.max("kind").alias("known")).join(names, ["k", "l", "canon"], "left_anti")
    names = names.unionByName(titled)
    open_ones = pieces.filter("not sure or kind is null").join(names, ["k", "l", "canon"]).withColumn("kind", F.col("known")).select("k", "l", "pos", "part", "kind", "canon", "gender")
    sure = materialise(pieces.filter("sure and kind is not null").select(open_ones.columns).unionByName(open_ones), "parts")
    table = surrogates(sure.select("kind", "canon", "gender"), key, known)
    if table_path is not None:
        table.write.parquet(table_path)
    got = sure.join(table, ["kind", "canon"]).groupBy("k", "l", "pos").agg(F.map_from_entries(F.collect_list(F.struct("part", "surrogate"))).alias("got"))
    shown = each.join(got, ["k", "l", "pos"], "left").select("k", "l", F.struct("pos", F.when(F.col("got").isNull(), F.col("mention")).otherwise(_render(F.col("mention"), F.col("of"), F.col("got"))).alias("new"), F.col("got").isNotNull().alias("hit")).alias("s"))
    found = shown.groupBy("k", "l").agg(F.array_sort(F.collect_list("s")).alias("s"))
    between = F.when(named, F.split("text", ENTITY_OR_WORD, -1)).otherwise(F.split("text", ENTITY, -1))
    whole = F.array_join(F.zip_with(between, F.transform("s", lambda s: s["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    hidden = own.join(found, ["k", "l"]).select(*(F.col(f"row.`{c}`") for c in kept), whole.alias(text_col), F.size(F.filter("s", lambda s: s["hit"])).cast("bigint").alias("n_entities"))
    hidden = materialise(hidden, "anonymised", keep=True)
    return hidden.unionByName(pure.select(*(F.col(f"`{c}`") for c in kept), text.alias(text_col), F.lit(0).cast("bigint").alias("n_entities")))
