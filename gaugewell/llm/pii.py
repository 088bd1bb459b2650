"""Personal data replaced by keyed surrogates.

Every entity gets a replacement of its own kind and form, derived from a secret
key (HMAC) and the entity's normal form, so the same entity reads the same
everywhere and nobody without the key can go back.  Numbers keep their grouping
and check digits, names their gender, script and case, letters stay letters.

Distinct entities must stay distinct: all surrogates of the corpus are compared
with each other and with all real entities, and who collides takes the next
attempt, until none does.  Only entities with another attempt than the first
are looked up in the second pass over the text.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, map_batches, row_key

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w+.])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w]|[ .-]?\d)|(?<![\w+])\+\d{8,15}(?!\w)")
SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)(\s*[=:]\s*[\"']?)((?=[+/_=-]*[A-Za-z0-9])[A-Za-z0-9+/_=-]{8,})")
#: Titles, and the gender they give a name.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Г-н": "m", "Господин": "m", "Г-жа": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PERSON = re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.?[  ]+({NAME})(?:[  ]+({NAME}))?(?:[  ]+({NAME}))?")
#: Consonants, vowels and the endings of given names (m, f) and surnames (m, f) of a script.
SCRIPTS = {
    "LATIN": ("bdfghklmnprstvz", "aeiou", ("n", "a"), ("er", "er")),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", ("н", "а"), ("ов", "ова")),
    "GREEK": ("βγδζθκλμνπρστ", "αειου", ("ος", "α"), ("ης", "η")),
}
NARROW_ATTEMPTS = 16  # then forms get longer, one character each time so many have failed again
ATTEMPT_ROWS = 100_000  # exceptions that are broadcast; more are joined


class Stream:
    """Numbers below a bound from HMAC-SHA256 of the key and a label."""

    def __init__(self, key: bytes, *label: object):
        self.key, self.label, self.round, self.value, self.left = key, "\x1f".join(map(str, label)).encode("utf-8", "surrogatepass"), 0, 0, 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.round += 1
            self.value = int.from_bytes(hmac.new(self.key, self.label + self.round.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.left = 1 << 256
        self.value, found = divmod(self.value, n)
        self.left //= n
        return found


def _shape(text: str, s: Stream) -> str:
    """Letters for letters, digits for digits."""
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(str(s.below(10)))
        elif c.isascii() and c.isalpha():
            d = chr(97 + s.below(26))
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _digits(form: str, new: str) -> str:
    """The digits of ``form`` replaced in order."""
    it = iter(new)
    return "".join([next(it) if c.isdigit() else c for c in form] + [*it])


def luhn_ok(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def script_of(name: str) -> str:
    for c in name:
        kind = unicodedata.name(c, "").split(" ")[0]
        if kind in SCRIPTS:
            return kind
    return "LATIN"


def _cased(new: str, form: str) -> str:
    if form.isupper() and len(form) > 1:
        return new.upper()
    return new if form.islower() else new.capitalize()


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The normal form of the replacement of an entity in normal form."""
    s = Stream(key, kind, norm, attempt)
    wider = attempt // NARROW_ATTEMPTS
    if kind == "email":
        local, _, domain = norm.partition("@")
        *labels, top = domain.split(".")
        d = Stream(key, "domain", domain)  # one domain stays one domain
        return f"{_shape(local + 'x' * wider, s)}@{'.'.join(_shape(x, d) for x in labels)}.{top}"
    if kind == "ip":
        first = int(norm.split(".")[0])
        private = first in (10, 127) or norm.startswith("192.168.")
        if private and wider:  # any private address, then any
            private, norm = wider == 1, "10.0.0.0"
        keep = norm.split(".")[: 2 if norm.startswith("192.168.") else 1] if private else [str([x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)][s.below(218)])]
        return ".".join([*keep, *(str(s.below(256)) for _ in range(4 - len(keep)))])
    if kind == "card":
        body = norm[0] + "".join(str(s.below(10)) for _ in norm[2:] + "0" * wider)
        return next(body + str(c) for c in range(10) if luhn_ok(body + str(c)))
    if kind == "iban":
        body = _shape(norm[4:] + "0" * wider, s)
        check = 98 - int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{check:02d}{body}"
    if kind in ("phone", "ssn"):
        plus = norm.startswith("+")
        digits = norm.lstrip("+")
        keep = digits[: max(0, len(digits) - 10)] if plus else ""
        rest = digits[len(keep) :]
        return "+" * plus + keep + str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in rest[1:] + "0" * wider) if rest else norm
    if kind in ("given-m", "given-f", "surname-m", "surname-f"):
        script = script_of(norm)
        consonants, vowels, given, family = SCRIPTS[script]
        ending = (given if kind.startswith("given") else family)[kind.endswith("f")]
        stem = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(max(2, (len(norm) + 1) // 2) + attempt // 4))
        return stem + consonants[s.below(len(consonants))] + ending
    if kind == "secret" and (m := re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", norm)):
        digits = "0123456789ABCDEF" if m[0] != m[0].lower() else "0123456789abcdef"
        return "".join(digits[s.below(16)] for _ in norm + "0" * wider)
    return _shape(norm + "x" * wider, s)


def _people(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Titled names, and the same names without a title elsewhere in the text."""
    names: dict[str, str] = {}
    for m in PERSON.finditer(text):
        words = [w for w in m.groups()[1:] if w]
        words = words[: next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))]
        gender = TITLES[m[1]]
        for i, w in enumerate(words):
            kind = ("surname-" if i == len(words) - 1 else "given-") + gender
            names.setdefault(w, kind)
    if names:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")(?!\w)", text):
            yield m.start(), m.end(), names[m[0]], m[0].lower()


def _found(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of what the patterns give, earlier kinds first where they overlap."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email", m[0].lower()
    low = None
    if any(x in text for x in ("=", ":")):
        low = text.lower()
        if any(x in low for x in ("passw", "pwd", "token", "secret", "key")):
            for m in SECRET.finditer(text):
                yield m.start(2), m.end(2), "secret", m[2]
    if re.search(r"\d{2}", text):
        for m in IPV4.finditer(text):
            yield m.start(), m.end(), "ip", m[0]
        for m in IBAN.finditer(text):
            norm = m[0].replace(" ", "")
            if iban_ok(norm):
                yield m.start(), m.end(), "iban", norm
        for m in CARD.finditer(text):
            norm = re.sub(r"\D", "", m[0])
            if luhn_ok(norm) and len(set(norm)) > 1:
                yield m.start(), m.end(), "card", norm
        for m in SSN.finditer(text):
            yield m.start(), m.end(), "ssn", m[0].replace("-", "")
        for m in PHONE.finditer(text):
            norm = re.sub(r"[^\d+]", "", m[0])
            if 8 <= len(norm.lstrip("+")) <= 15:
                yield m.start(), m.end(), "phone", norm
    if any(t in text for t in TITLES):
        yield from _people(text)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order, none overlapping."""
    taken: list[tuple[int, int, str, str]] = []
    for e in _found(text):
        at = bisect.bisect(taken, e[:1])
        if (at == 0 or taken[at - 1][1] <= e[0]) and (at == len(taken) or e[1] <= taken[at][0]):
            taken.insert(at, e)
    return taken


def rendered(kind: str, form: str, new: str) -> str:
    """A surrogate's normal form in the form the entity had in the text."""
    if kind == "email":
        return new.upper() if form.isupper() else new
    if kind in ("card", "ssn", "phone"):
        return _digits(form, new.lstrip("+"))
    if kind == "iban":
        it = iter(new)
        return "".join([c if c == " " else next(it) for c in form] + [*it])
    if kind.startswith(("given", "surname")):
        return _cased(new, form)
    return new


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, int]:
    """The text with all entities replaced, and their number."""
    found = entities(text)
    out, at = [], 0
    for a, b, kind, norm in found:
        out += [text[at:a], rendered(kind, text[a:b], surrogate(kind, norm, attempts.get((kind, norm), 0), key))]
        at = b
    return "".join([*out, text[at:]]), len(found)


def find_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each entity: id, row_key, start, end (characters), kind, norm, form."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), row_key(df, id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = [(i, k, *e, t[e[0] : e[1]]) for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))) if t for e in entities(t)]
            yield dict(zip(("id", "row_key", "start", "end", "kind", "norm", "form"), map(list, zip(*found)) if found else [[]] * 7))

    return map_batches(rows, run, f"id {kind}, row_key binary, start int, end int, kind string, norm string, form string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, attempt, new of all distinct (kind, norm) in ``found``; no new form is another's or a real one.

    Names are compared as words whatever their kind, the rest within its kind.
    An entity with a smaller (attempt, norm) keeps a form that several have.
    """

    def make(batches):
        for batch in batches:
            c = batch.to_pydict()
            yield c | {"new": [surrogate(k, n, a, key) for k, n, a in zip(c["kind"], c["norm"], c["attempt"])]}

    schema = "kind string, norm string, attempt int, new string"
    group = lambda column: F.regexp_replace(column, "^(given|surname)-.$", "name")
    known = cut_lineage(found.select("kind", "norm").distinct())
    real = known.select(group(F.col("kind")).alias("group"), F.col("norm").alias("new")).distinct().withColumn("real", F.lit(True))
    made = cut_lineage(map_batches(known.withColumn("attempt", F.lit(0)), make, schema))
    while True:
        grouped = made.withColumn("group", group(F.col("kind")))
        first = grouped.groupBy("group", "new").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"), F.count("*").alias("n"))
        taken = first.join(real, ["group", "new"], "left").filter("n > 1 or real")
        lost = cut_lineage(grouped.join(taken, ["group", "new"]).filter("real or first != struct(attempt, kind, norm)").select("kind", "norm", F.col("attempt") + 1))
        if lost.isEmpty():
            return made
        kept = made.join(lost.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "new")
        again = map_batches(lost.toDF("kind", "norm", "attempt"), make, schema)
        made = cut_lineage(kept.unionByName(again))


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = ATTEMPT_ROWS) -> DataFrame:
    """id_col, text (entities replaced), entities (their number) of every row.

    The kinds are email, secret, ip, iban, card, ssn, phone, and given names
    and surnames after a title (then also without it in the same text).  Null
    texts stay null with 0 entities, empty ones empty; null ids and repeated
    rows are handled like others; other columns are ignored.
    """
    found = cut_lineage(find_entities(df, id_col, text_col).select("row_key", "kind", "norm"))
    odd = cut_lineage(assign(found, key).filter("attempt > 0").select("kind", "norm", "attempt"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), row_key(df, id_col, text_col).alias("row_key"))
    few = odd.count() <= broadcast_rows
    if few:
        held = df.sparkSession.sparkContext.broadcast({(r["kind"], r["norm"]): r["attempt"] for r in odd.collect()})
        rows = rows.select("id", "text")
    else:
        mine = found.distinct().join(odd, ["kind", "norm"]).groupBy("row_key").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("odd"))
        rows = rows.join(mine, "row_key", "left").select("id", "text", "odd")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [held.value] * len(texts) if few else [{(o["kind"], o["norm"]): o["attempt"] for o in odd or ()} for odd in batch.column(2).to_pylist()]
            done = [replaced(t, k, key) if t else (t, 0) for t, k in zip(texts, known)]
            yield {"id": batch.column(0), "text": [t for t, _ in done], "entities": [n for _, n in done]}

    return map_batches(rows, run, f"id {kind}, text string, entities int").withColumnsRenamed({"id": id_col, "text": text_col})
