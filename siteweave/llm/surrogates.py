"""Personal data replaced by keyed surrogates of the same kind and form."""

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from siteweave.llm.common import saved, table, texts_of

# --- fixed values: given names by script and gender, titles, syllables ----------------
#: Given names that surrogates are taken from.
NAMES = {
    ("latin", "f"): ["Anna", "Maria", "Julia", "Emma", "Laura", "Clara", "Elena", "Sarah", "Claire", "Carmen"],
    ("latin", "m"): ["John", "Peter", "Paul", "Thomas", "Martin", "David", "Lucas", "Daniel", "Pierre", "Carlos"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ιωάννα"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"],
}
#: More given names that are looked for.
FURTHER = {
    ("latin", "f"): """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Lisa Nancy Betty Margaret Sandra
        Ashley Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Helen Rachel
        Olivia Sophia Sophie Charlotte Amelia Isabella Hannah Alice Jane Kate Lucy Grace Victoria Katharina Sabine Petra
        Monika Ursula Heike Birgit Ingrid Greta Lena Lea Mia Marie Camille Chloé Élodie Isabelle Juliette Amélie Nathalie
        Isabel Lucía Sofía Paula Marta Teresa Rosa Pilar Ana Inés Giulia Francesca Chiara Fatima Aisha Priya""",
    ("latin", "m"): """James Robert Michael William Richard Joseph Charles Christopher Matthew Anthony Mark Steven Andrew
        Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen
        Larry Justin Scott Brandon Benjamin Samuel Gregory Patrick Frank Jack Henry Oliver Harry Noah Liam Hans Klaus Jürgen
        Wolfgang Stefan Andreas Michel Jean Jacques François Antoine Louis Philippe Nicolas Julien Felix Max Maximilian Jonas
        Leon Lukas Karl Friedrich Heinrich Günter Werner Uwe José Juan Luis Miguel Javier Antonio Francisco Manuel Pedro Diego
        Alejandro Pablo Marco Giovanni Giuseppe Luca Mohammed Ahmed Ali Omar Raj""",
    ("cyrillic", "f"): "Екатерина Анастасия Юлия Людмила Галина Валентина Надежда Вера Любовь Дарья Ксения Алина Полина Марина Оксана София",
    ("cyrillic", "m"): "Александр Владимир Виктор Юрий Евгений Игорь Олег Павел Антон Максим Роман Борис Денис Константин Василий Григорий Петр",
    ("greek", "f"): "Βασιλική Δήμητρα Γεωργία Ευαγγελία Αγγελική Χριστίνα Παρασκευή Ειρήνη Αναστασία",
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλης Χρήστος Αθανάσιος Μιχάλης Σπύρος",
}
TITLES = {
    "Mr": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f",
    "Señora": "f", "Madame": "f", "Dr": "", "Prof": "", "Sir": "m", "Signor": "m", "Signora": "f", "Professor": "", "Doctor": "",
    "Κύριος": "m", "Κυρία": "f", "Господин": "m", "Госпожа": "f",
}
SYLLABLES = {
    "latin": ["ba", "den", "ful", "gor", "han", "kel", "lin", "mor", "nev", "pas", "ros", "tam", "vil", "wes", "zim", "cot"],
    "cyrillic": ["бар", "вел", "гор", "дом", "жар", "зим", "кол", "лаз", "мор", "нев", "пол", "рос", "сол", "тар", "фед", "яс"],
    "greek": ["βαρ", "γαλ", "δημ", "ζαν", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παν", "ραλ", "σταμ", "ταρ", "φιλ", "χαρ", "ψαρ"],
}
ENDINGS = {"latin": "", "cyrillic": "ов", "greek": "ης"}
#: How a made-up given name ends.
GIVEN_ENDINGS = {
    ("latin", "f"): "ina", ("latin", "m"): "us", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ан", ("greek", "f"): "ία", ("greek", "m"): "ος",
}
#: Country codes of telephone numbers: these have one digit, these two, all others three.
CODES_1 = {"1", "7"}
CODES_2 = {
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
    "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
#: How keys of some vendors begin.
VENDORS = [
    "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-",
    "sk_live_", "rk_live_", "sk-", "AIza",
]
# ---------------------------------------------------------------------------------------

GIVEN = {of: list(dict.fromkeys([*names, *FURTHER[of].split()])) for of, names in NAMES.items()}
GENDER = {(script, name): gender for (script, gender), names in GIVEN.items() for name in names}


def any_of(words: Iterable[str]) -> str:
    """A pattern of the words, longest first, that looks at their first letters first."""
    by_first: dict[str, list[str]] = {}
    for word in sorted(set(words), key=len, reverse=True):
        by_first.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))


_given = any_of(name for names in GIVEN.values() for name in names)
_title = any_of(TITLES)
_capital, _small = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ", "a-zß-öø-ÿа-яёα-ωά-ώ"
_surname = rf"(?:[{_capital}]['’])?[{_capital}][{_small}]+(?:[{_capital}][{_small}]+)?(?:-[{_capital}][{_small}]+)*"
_first = "".join(sorted({name[0] for name in [*TITLES, *(n for names in GIVEN.values() for n in names)]}))
_hex = "[0-9A-Fa-f]{1,4}"
_vendor = any_of(VENDORS)

#: What is looked for, the earlier kinds first where two begin at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:token|secret(?:[_-]?(?:access[_-]?)?key)?|password|passwd|passphrase|pwd|(?:api|access|private|auth|account|encryption)[_-]?key)[\"']?\s*(?:=>|:=|[=:])\s*[\"']?)(?P<value>[A-Za-z0-9+/_-]{12,}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{6,})"
    rf"|(?<![A-Za-z0-9])(?:{_vendor}|[Bb]earer )(?P<keyed>[A-Za-z0-9_-]{{16,}})"
    r"|(?<![A-Za-z0-9])(?P<hex>(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![A-Za-z0-9])",
    "ip6": rf"(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_hex}:){{7}}{_hex}|[0-9A-Fa-f]{{3,4}}(?::{_hex}){{0,5}}::(?:{_hex}(?::{_hex}){{0,5}})?)(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?(?:[A-Z]{4} ?|[A-Z])?\d{3,4}(?: ?\d{4}){1,6}(?: ?\d{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w.+-])(?:\d{3}[-. ]\d{3}[-. ]\d{4}|\(0[1-9]\d{1,3}\) ?\d{3,4}[ -]?\d{2,5}|0[1-9]\d{1,3}(?:[ /-]\d{5,8}|[ /-]\d{3,4}[ -]\d{3,5})|0[1-9](?:[ .-]\d{2}){4})(?![\w-]|[.]\d)",
    "person": rf"\b(?=[{_first}])(?:(?P<title>{_title})\b\.? (?:(?P<given1>{_given}) )?|(?P<given2>{_given}) )(?:(?P<given3>{_given}) )?(?:[{_capital}]\. )?(?P<surname>{_surname})\b",
}
FOUND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
NAME = re.compile(rf"\b{_surname}\b")
#: Every text with something to find has one of these bytes, or one of BEGINNINGS where no word
#: goes on.
SIGNS = b"0123456789@=:"
_others = bytes(set(range(256)) - set(SIGNS))
BEGINNINGS = [
    *[f"{name} " for names in GIVEN.values() for name in names],
    *[f"{title}{dot} " for title in TITLES for dot in ("", ".")],
    *VENDORS, "Bearer ", "bearer ",
]


def tracer() -> Callable[[bytes], bool]:
    """Whether a text may hold something to find, by its bytes and one automaton."""
    automaton = ahocorasick.Automaton()
    for text in BEGINNINGS:
        automaton.add_word(text, len(text))
    automaton.make_automaton()

    def may_hold(raw: bytes) -> bool:
        if raw.translate(None, _others):
            return True
        text = raw.decode("utf-8", "replace")
        starts = (end + 1 - length for end, length in automaton.iter(text))
        return any(start == 0 or not text[start - 1].isalnum() for start in starts)

    return may_hold


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def stem_of(surname: str) -> str:
    """A surname without its feminine ending, which the surrogate takes on again."""
    return surname[:-1] if script_of(surname) == "cyrillic" and surname.endswith(("ова", "ева", "ина")) else surname


def parts_of(match: re.Match) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of a find. Forms of one entity share the canonical
    form: digits without their separators, letters without case where case means nothing."""
    kind = match.lastgroup if match.lastgroup in PATTERNS else next(k for k in PATTERNS if match[k] is not None)
    if kind == "person":
        out = []

        for group in ("given1", "given2", "given3"):
            if name := match[group]:
                script = script_of(name)
                out.append((f"given-{script}-{GENDER[script, name]}", name, *match.span(group)))
        stem = stem_of(match["surname"])
        out.append((f"surname-{script_of(stem)}", stem, match.start("surname"), match.start("surname") + len(stem)))

        return out
    if kind == "secret":
        group = next(g for g in ("value", "keyed", "hex") if match[g] is not None)
        return [(kind, match[group].lower() if is_hex(match[group]) else match[group], *match.span(group))]
    if kind in ("email", "ip6"):
        return [(kind, match[0].lower(), *match.span())]
    if kind == "iban":
        return [(kind, match[0].replace(" ", ""), *match.span())]
    if kind == "ip":
        return [(kind, match[0], *match.span())]
    digits = re.sub(r"\D", "", match[0])
    if kind == "card" and luhn(digits) != 0:
        return []  # a number of some other kind
    return [(kind, "+" * (match[0][0] == "+") + digits, *match.span())]


def is_hex(text: str) -> bool:
    return re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None


def found_in(text: str) -> list[tuple[str, str, int, int]]:
    """The finds in their order, and every further mention of the names among them."""
    found = [part for match in FOUND.finditer(text) for part in parts_of(match)]
    names = {canon: kind for kind, canon, *_ in found if kind.startswith("given-")}
    names |= {canon: kind for kind, canon, *_ in found if kind.startswith("surname-")}
    if not names:
        return found
    spans, k, more = [f[2:] for f in found], 0, []
    for match in NAME.finditer(text):
        while k < len(spans) and spans[k][1] <= match.start():
            k += 1
        name = match[0] if match[0] in names else stem_of(match[0])
        if name in names and (k == len(spans) or match.end() <= spans[k][0]):
            more.append((names[name], name, match.start(), match.start() + len(name)))
    return sorted([*found, *more], key=lambda f: f[2]) if more else found


def numbers(key: bytes, *about: str) -> Iterator[int]:
    """A keyed stream of numbers below 2**32 about some strings."""
    block = 0
    while True:
        digest = hmac.new(key, "\0".join([*about, str(block)]).encode(), hashlib.sha256).digest()
        for k in range(0, 32, 4):
            yield int.from_bytes(digest[k : k + 4], "big")
        block += 1


def like(text: str, stream: Iterator[int], letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Each letter a letter, each digit a digit, the first digit zero only if it was."""
    out = []
    for k, c in enumerate(text):
        if c.isdigit():
            out.append(c if k == 0 and c == "0" else str(1 + next(stream) % 9) if k == 0 else str(next(stream) % 10))
        elif c.isascii() and c.isalpha():
            new = letters[next(stream) % len(letters)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def code_length(digits: str) -> int:
    """Digits of the country's code that a telephone number begins with."""
    return 1 if digits[:1] in CODES_1 else 2 if digits[:2] in CODES_2 else 3


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of what stands for an entity, at an attempt. Later attempts may be
    longer, so there is always one that is free."""
    stream = numbers(key, kind, canon, str(attempt))
    longer = attempt // 8
    if kind == "email":
        local, domain = canon.split("@", 1)
        name, _, top = domain.rpartition(".")
        # a domain has one surrogate, whoever writes from it
        host = like(name, numbers(key, "domain", domain))
        return like(local + "x" * longer, stream) + "@" + host + "." + top
    if kind == "secret":
        return "".join(f"{next(stream) % 16:x}" for _ in canon) if is_hex(canon) else like(canon, stream)
    if kind == "ip6":
        return like(canon, stream, "abcdef")
    if kind == "iban":
        out = canon[:4] + like(canon[4:], stream)
        return f"{out[:2]}{98 - iban_rest(out[:2] + '00' + out[4:]):02}{out[4:]}" if iban_rest(canon) == 1 else out
    if kind == "ip":
        return ".".join(str(1 + next(stream) % 254) for _ in range(4))
    if kind == "phone":
        # the country's code or the trunk's 0
        keep = 1 + code_length(canon[1:]) if canon[0] == "+" else int(canon[0] == "0")
        return canon[:keep] + like("1" + canon[keep + 1 :], stream)
    if kind == "card":
        out = like(canon, stream)
        return out[:-1] + str((10 - luhn(out[:-1] + "0")) % 10)
    if kind.startswith("given-"):
        _, script, gender = kind.split("-")
        names = NAMES[script, gender]
        if attempt < len(names):
            return names[(next(numbers(key, kind, canon)) + attempt) % len(names)]
        return made_name(script, stream, 2 + longer) + GIVEN_ENDINGS[script, gender]
    if kind.startswith("surname-"):
        script = kind.split("-")[1]
        return made_name(script, stream, 2 + longer) + ENDINGS[script]
    return like(canon, stream)


def made_name(script: str, stream: Iterator[int], length: int) -> str:
    syllables = SYLLABLES[script]
    return "".join(syllables[next(stream) % len(syllables)] for _ in range(length)).capitalize()


def in_form_of(kind: str, given: str, new: str) -> str:
    """The canonical surrogate with the separators and the case of what it replaces."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in given)
    if kind == "iban":
        signs = iter(new)
        return "".join(c if c == " " else next(signs) for c in given)
    if kind in ("email", "secret", "ip6") and given.isupper():
        return new.upper()
    return new


def rewritten(text: str, chosen: Callable[[str, str], str]) -> tuple[str, list[str]]:
    """The text with each find replaced, and the kinds found."""
    out, at, kinds = [], 0, []
    for kind, canon, start, end in found_in(text):
        out += [text[at:start], in_form_of(kind, text[start:end], chosen(kind, canon))]
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate), one row per entity; no two of a kind share a surrogate, and
    none is an entity that the texts hold.

    Attempts go on for the entities whose surrogate is taken: by an original, by an entity
    settled before, or by one with a smaller canonical form. Few ever need a second one.
    """

    def attempt_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            pdf["surrogate"] = [surrogate(key, *row) for row in pdf[["kind", "canon", "attempt"]].itertuples(index=False, name=None)]
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    taken = entities.select("kind", F.col("canon").alias("surrogate"))
    open_, done, attempt = entities, None, 0
    while True:
        tried = saved(
            open_.select("kind", "canon", F.lit(attempt).alias("attempt")).mapInArrow(
                attempt_rows, "kind string, canon string, attempt int, surrogate string"
            )
        )
        first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        settled = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canon", "surrogate")
        done = saved(settled if done is None else done.union(settled))
        open_ = saved(tried.join(done, ["kind", "canon"], "left_anti").select("kind", "canon"))
        if open_.isEmpty():
            return done
        taken = entities.select("kind", F.col("canon").alias("surrogate")).union(done.select("kind", "surrogate"))
        attempt += 1


def detect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that hold entities, with the distinct ones of each."""
    may_hold = tracer()
    for batch in batches:
        at, marks, finds = [], [], []
        for k, raw in enumerate(texts_of(batch.column(1))):
            if raw and may_hold(raw) and (found := {f[:2] for f in found_in(raw.decode("utf-8", "replace"))}):
                at.append(k)
                marks.append(xxh3_64_intdigest(raw) >> 1)
                finds.append([{"kind": kind, "canon": canon} for kind, canon in sorted(found)])
        some = batch.take(pa.array(at, pa.int64()))
        pair = pa.struct([("kind", pa.string()), ("canon", pa.string())])
        yield pa.RecordBatch.from_arrays(
            [some.column(0), pa.array(marks, pa.int64()), some.column(1), pa.array(finds, pa.list_(pair))],
            names=["doc_id", "mark", "text", "finds"],
        )


def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that hold none, as they are."""
    may_hold = tracer()
    for batch in batches:
        keep = [
            not raw or not may_hold(raw) or not found_in(raw.decode("utf-8", "replace"))
            for raw in texts_of(batch.column(1))
        ]
        yield batch.filter(pa.array(keep, pa.bool_()))


def replaced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, numbers_, kinds = [], [], []
        for raw, pairs in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if not pairs:
                texts.append(raw)
                numbers_.append(0)
                kinds.append([])
                continue
            table_ = {(p["kind"], p["canon"]): p["surrogate"] for p in pairs}
            text, found = rewritten(raw.decode("utf-8", "replace"), lambda k, c, t=table_: t[k, c])
            texts.append(text.encode())
            numbers_.append(len(found))
            kinds.append(sorted({k.split("-")[0] for k in found}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(numbers_, pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
            names=["doc_id", "text", "n_entities", "kinds"],
        )


def with_surrogates(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts with their personal data replaced: e-mail addresses, secrets, IP addresses, bank
    accounts, card, social security and telephone numbers, and names of persons after a title
    or with a given name, with all further mentions of a name in the text it was found in.

    A surrogate comes from a keyed hash, so it can't be traced without the key, and has the
    form of what it replaces: separators, case, lengths, country code, check digit, script,
    and the gender of given names. One entity has one surrogate in all texts and forms, two
    entities never share one (see `assigned`). Equal rows give equal texts.

    The entities of all texts meet in one table; a text gets only its own ones back. Texts
    without entities are not moved at all. Numbers of a card's length count as cards when
    their check digit is right.

    Returns one row per row: doc_id, text, n_entities (places replaced), kinds. Null texts
    stay null with 0 entities; rows without id are rewritten like others; no rows give none.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    kept = saved(
        narrow.mapInArrow(detect, "doc_id long, mark long, text string, finds array<struct<kind: string, canon: string>>")
    )
    found = kept.select("doc_id", "mark", F.inline("finds")).distinct()
    entities = saved(found.select("kind", "canon").distinct())
    chosen = assigned(entities, key)
    pairs = (
        found.join(chosen, ["kind", "canon"])
        .groupBy("doc_id", "mark")
        # the entities of one text
        .agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("pairs"))
        .withColumnsRenamed({"doc_id": "i", "mark": "m"})
    )
    joined = kept.join(saved(pairs), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    moved = joined.select("doc_id", "text", "pairs").mapInArrow(
        replaced, "doc_id long, text string, n_entities int, kinds array<string>"
    )
    unmoved = narrow.mapInArrow(untouched, "doc_id long, text string").select(
        "doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds")
    )
    return moved.union(unmoved)


#: A key of a real run comes from the caller; this one makes the query repeatable.
QUERY_KEY = b"registered query"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return with_surrogates(table(spark, sf_dir, "documents"), QUERY_KEY)
