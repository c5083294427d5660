"""Personal data: base patterns, and spans added by weak supervision.

Base spans (email, ip, card, phone) follow fixed rules and always stay.
Further candidates are judged: phone numbers in national form, national ids,
account numbers, masked email addresses, and names of persons (two or more
capitalised words in a row, wherever they stand).  Three labelers vote on every
span, base ones included, or abstain:

* regex: the span's own form (checksums, number ranges, titles, shapes),
* gazetteer: lists of given names, places and institutions, calling codes, account
  countries, card issuers and role mailboxes, met inside the span,
* context: words on the same line close around the span.

Expectation-maximisation over the votes estimates how reliable each labeler is
and how probable each vote pattern is to be personal data.  With these soft
labels a logistic classifier is trained that never sees a vote: its features are
the kind, the span's shape, its neighbours and hashed words beside it.  It decides
on the added kinds; a span is taken at ``ACCEPT`` or more.

Expectation-maximisation works on counts of vote patterns, 27 at most, over all
documents.  The classifier is fitted on a bounded sample, the ``FIT_PATTERNS`` most
frequent feature patterns with their counts, and its weights go to the tasks, which
judge every span by its own features.  So what the driver and a task hold of either does
not grow with the documents; patterns stay a table.

A text is read once; what later steps need (spans and patterns) is written to
the shared folder.  All patterns run in linear time on whole texts, and no part
of a span has a greatest length.

Defined results: null and empty texts have no spans; every input row gives one
row, repeated ones too; positions count code points, ends are exclusive; an
added span that overlaps a base span or an earlier added one is left out; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, small_batches, stored

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("national_phone", "national_id", "account", "masked_email", "person")
KINDS = BASE_KINDS + ADDED_KINDS
BATCH_BYTES = 1 << 20
ACCEPT = 0.5
#: Words on each side of a span that the context labeler looks at.
CONTEXT_WORDS = 4
#: Feature patterns that the classifier is fitted on, at most.
FIT_PATTERNS = 20_000
#: Buckets of the words beside a span, as the classifier sees them.
WORD_BUCKETS = 16

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_FREE = r"(?<![0-9A-Za-z])"
_MORE = {
    "national_phone": re.compile(_FREE + r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "national_id": re.compile(_FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])"),
    "account": re.compile(_FREE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "masked_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)+"),
    "person": re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|M)\.\x20)?[A-Z\u00c0-\u00de][^\W\d_]++(?:\x20[A-Z]\.)*+(?:[\x20'-][A-Z\u00c0-\u00de][^\W\d_]++)++"),
}
_CAPITALS = re.compile(r"[A-Z\u00c0-\u00de][^\W\d_]++[\x20'-][A-Z\u00c0-\u00de]|[A-Z]\.\x20[A-Z\u00c0-\u00de]")
_WORD = re.compile(r"[^\W\d_][\w'-]*")

# Titles before names, in English, German, French and Spanish.
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra".split())
# Common given names of the same languages.
GIVEN_NAMES = frozenset("""
james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george kevin brian
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily anna emma laura alice
hans peter klaus wolfgang jürgen stefan andreas uwe matthias ursula monika sabine petra heike claudia birgit lukas leon felix greta
jean pierre michel philippe alain nicolas marie nathalie isabelle sylvie catherine camille louis jules chloé léa amélie
josé antonio manuel francisco juan carlos luis miguel javier alejandro maría carmen ana isabel pilar dolores lucía marta
""".split())
# Places and parts of their names.
PLACES = frozenset("""
london paris berlin madrid york angeles francisco chicago boston washington texas california hamburg munich münchen köln frankfurt vienna wien zürich
lyon marseille toulouse barcelona sevilla valencia rome milan america england germany france spain europe africa asia north south east west new san los
street road avenue square park river lake mount island city county state bridge station airport
""".split())
# Words of the names of institutions.
INSTITUTIONS = frozenset("""
university college school institute academy bank company corporation corp inc ltd llc gmbh museum hospital church ministry department committee
council court office agency press journal times post foundation association society union license software project group team university universität
""".split())
# International calling codes of the larger countries.
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 420".split())
# Lengths of account numbers by country.
ACCOUNT_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
# Mailboxes of a role rather than of a person.
ROLES = frozenset("info support admin office sales contact noreply no-reply webmaster postmaster hello team service help press jobs".split())

#: Words that speak for a kind when they stand close to a span.
CUES = {
    "email": "email mail e-mail contact correo courriel write reach", "ip": "ip address host server client adresse login from",
    "card": "card visa mastercard credit debit karte carte tarjeta", "phone": "phone tel telephone call me mobile fax cell telefon téléphone teléfono",
    "national_phone": "phone tel telephone call me mobile fax cell telefon téléphone teléfono", "national_id": "ssn social security id identity",
    "account": "iban account bank konto compte cuenta", "masked_email": "email mail e-mail contact correo courriel write reach",
    "person": "dear name named contact by signed sincerely regards from told said met says mother father wife husband born aged",
}
CUE_WORDS = {k: frozenset(v.split()) for k, v in CUES.items()}
#: Words that speak against any kind.
AGAINST = frozenset("isbn issn doi version order invoice item part model serial figure table page chapter section total price example".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    floor = 0
    while at >= 0:
        before = text[max(last, floor) : at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        floor = at + 1
        at = text.find("@", at + 1)


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind as listed, then by start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _DIGIT.search(text):
        found += [(k, m.start(), m.end()) for k in ("national_phone", "national_id", "account") for m in _MORE[k].finditer(text)]
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [("masked_email", m.start(), m.end()) for m in _MORE["masked_email"].finditer(text)]
    if _CAPITALS.search(text):
        found += [("person", m.start(), m.end()) for m in _MORE["person"].finditer(text)]
    return found


FOR, AGAINST_IT, NONE = 1, 2, 0


def _vote(yes: bool, no: bool = False) -> int:
    return FOR if yes else AGAINST_IT if no else NONE


def by_form(kind: str, span: str) -> int:
    """Vote of the regex labeler."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "national_phone":
        return _vote(digits[0] > "1" and digits[3] > "1", True)
    if kind == "national_id":
        return _vote(not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"), True)
    if kind == "account":
        plain = span.replace(" ", "")
        return _vote(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1, True)
    if kind == "masked_email":
        return _vote(bool(re.search(r"[A-Za-z]{2,}$", span)), True)
    if kind == "person":
        words = _WORD.findall(span)
        return _vote(words[0].lower() in TITLES or "." in span, len(words) > 4)
    if kind == "ip":
        return _vote(not span.startswith("0"), True)
    if kind == "phone":
        return _vote(len(digits) >= 10, len(digits) < 9)
    if kind == "email":
        return _vote(bool(re.search(r"\.[A-Za-z]{2,}$", span)), True)
    return FOR


def by_gazetteer(kind: str, span: str) -> int:
    """Vote of the gazetteer labeler."""
    if kind == "person":
        words = [w.lower() for w in _WORD.findall(span)]
        return _vote(any(w in GIVEN_NAMES for w in words), any(w in PLACES or w in INSTITUTIONS for w in words))
    if kind in ("email", "masked_email"):
        local = re.split(r"[^a-z]+", re.split(r"[@\[(]", span.lower(), maxsplit=1)[0].strip())
        return _vote(any(w in GIVEN_NAMES for w in local), any(w in ROLES for w in local))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "phone":
        return _vote(digits.startswith(CALLING_CODES), True)
    if kind == "account":
        plain = span.replace(" ", "")
        return _vote(ACCOUNT_LENGTHS.get(plain[:2]) == len(plain), plain[:2] not in ACCOUNT_LENGTHS)
    if kind == "card":
        return _vote(digits[0] in "456" or digits[:2] in ("34", "37"), True)
    if kind == "ip":
        first, second = (int(x.lstrip("0") or "0") for x in span.split(".")[:2])
        return _vote(False, first in (0, 10, 127) or first >= 224 or (first, second) == (192, 168))
    if kind == "national_phone":
        return _vote(False, digits[3:8] == "55501")
    return NONE


def by_context(kind: str, before: list[str], after: list[str]) -> int:
    """Vote of the context labeler."""
    words = {w.lower() for w in before} | {w.lower() for w in after}
    return _vote(bool(words & CUE_WORDS[kind]), bool(words & AGAINST))


def _side(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else "p"


def _shape(kind: str, span: str) -> str:
    """What the classifier sees of a span: separators, groups and length, coarsely."""
    if kind == "person":
        words = span.split()
        return f"{min(4, len(words))}{min(9, max(map(len, words)))}"
    marks = "".join(sorted({c for c in span if not c.isalnum()} & set(" -.()[]@+")))
    return f"{marks}{min(20, sum(c.isdigit() for c in span))}"


def _bucket(words: list[str], nearest: int) -> int:
    return 1 + zlib.crc32(words[nearest].lower().encode()) % WORD_BUCKETS if words else 0


def patterns(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """kind|votes|shape|left|right|word before|word after of each span: what the
    models see.  Words count up to the ends of the span's line."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    breaks = [m.start() for m in re.finditer(r"\n", text)]
    out = []
    for kind, start, end in spans:
        line = bisect_left(breaks, start)
        low, high = breaks[line - 1] + 1 if line else 0, breaks[line] if line < len(breaks) else len(text)
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        before = [text[a:b] for a, b in words[max(0, i - CONTEXT_WORDS) : i] if a >= low]
        after = [text[a:b] for a, b in words[j : j + CONTEXT_WORDS] if b <= high]
        span = text[start:end]
        left, right = _side(text[start - 1 : start]), _side(text[end : end + 1])
        votes = f"{by_form(kind, span)}{by_gazetteer(kind, span)}{by_context(kind, before, after)}"
        out.append(f"{kind}|{votes}|{_shape(kind, span)}|{left}|{right}|{_bucket(before, -1)}|{_bucket(after, 0)}")
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", BATCH_BYTES):
        spans = []
        for text in b.column(1).to_pylist():
            text = text or ""
            found = base_spans(text) + candidates(text)
            spans.append([{"kind": k, "start": a, "end": e, "pattern": p} for (k, a, e), p in zip(found, patterns(text, found), strict=True)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPAN)], names=["doc_id", "found"])


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over weighted vote patterns (rows; 1 for, 2 against, 0 none):
    (probability of each pattern to be positive, [labeler, class, vote] rates, prior)."""
    for_, against = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    p = np.clip(0.5 + 0.2 * (for_ - against), 0.1, 0.9)
    rates, prior = np.full((votes.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        mass = np.stack([(1 - p) * weight, p * weight])
        prior = float(np.clip(mass[1].sum() / max(mass.sum(), 1e-9), 0.01, 0.99))
        for j in range(votes.shape[1]):
            for c in (0, 1):
                n = np.bincount(votes[:, j], weights=mass[c], minlength=3) + 1.0
                rates[j, c] = n / n.sum()
        score = np.log(prior / (1 - prior)) + sum(np.log(rates[j, 1, votes[:, j]] / rates[j, 0, votes[:, j]]) for j in range(votes.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, rates, prior


def features(pattern: str) -> list[str]:
    """A pattern's features: what surrounds and shapes a span, all crossed with its
    kind; votes are left out."""
    kind, _, shape, left, right, before, after = pattern.split("|")
    return ["", kind, *(f"{kind} {name}={x}" for name, x in (("shape", shape), ("left", left), ("right", right), ("before", before), ("after", after)))]


def fit_logistic(x: np.ndarray, size: int, y: np.ndarray, weight: np.ndarray, rounds: int = 30, penalty: float = 1.0) -> np.ndarray:
    """Newton steps for weighted soft labels; ``x`` lists each row's features.  Each
    step is solved by conjugate gradients, so no matrix of features by features is made."""
    sums = lambda v: np.bincount(x.ravel(), weights=np.broadcast_to(v[:, None], x.shape).ravel(), minlength=size)
    w = np.zeros(size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        curve = weight * p * (1 - p)
        rest = sums(weight * (y - p)) - penalty * w
        step, way, left = np.zeros(size), rest.copy(), float(rest @ rest)
        enough = 1e-16 * max(left, 1e-300)
        for _ in range(4 * size):
            if left <= enough:
                break
            curved = sums(curve * way[x].sum(axis=1)) + penalty * way
            size_of_step = left / float(way @ curved)
            step += size_of_step * way
            rest = rest - size_of_step * curved
            before, left = left, float(rest @ rest)
            way = rest + left / before * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def weights_of(counts: dict[str, int], soft: dict[str, float]) -> dict[str, float]:
    """The classifier's weight of each feature, from patterns with their counts and the
    probability of each vote pattern."""
    if not counts:
        return {}
    listed = sorted(counts)
    weight = np.array([counts[p] for p in listed], float)
    weight = weight / weight.max() * 1e4  # the scale of the counts does not change the fit
    rows = [features(p) for p in listed]
    at = {n: i for i, n in enumerate(sorted({n for row in rows for n in row}))}
    x = np.array([[at[n] for n in row] for row in rows], np.int64)
    w = fit_logistic(x, len(at), np.array([soft[p.split("|")[1]] for p in listed]), weight)
    return {n: float(w[i]) for n, i in at.items()}


def chance(pattern: str, weights: dict[str, float]) -> float:
    """Probability of a span to be personal data, by its features that the fit has seen."""
    return float(1 / (1 + np.exp(-np.clip(sum(weights.get(n, 0.0) for n in features(pattern)), -30, 30))))


def soft_labels(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each vote pattern, by the labelers' estimated reliabilities."""
    if not counts:
        return {}
    listed = sorted(counts)
    weight = np.array([counts[v] for v in listed], float)
    p, _, _ = reliabilities(np.array([[int(c) for c in v] for v in listed]), weight / weight.max() * 1e4)
    return dict(zip(listed, p.tolist(), strict=True))


def judged_patterns(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each pattern to be personal data, by the final classifier."""
    votes: dict[str, int] = {}
    for p, n in counts.items():
        votes[p.split("|")[1]] = votes.get(p.split("|")[1], 0) + n
    weights = weights_of(counts, soft_labels(votes))
    return {p: chance(p, weights) for p in counts}


def with_added(base: list[dict], added: list[dict]) -> list[dict]:
    """Base spans, and of the added ones (by start, then kind) those that overlap
    nothing taken before, by kind, then start."""
    taken = []  # base spans as disjoint intervals in order
    for s in sorted(base, key=lambda s: s["start"]):
        if taken and s["start"] < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], s["end"])
        else:
            taken.append([s["start"], s["end"]])
    out, i, last = list(base), 0, 0
    for s in sorted(added, key=lambda s: (s["start"], KINDS.index(s["kind"]))):
        while i < len(taken) and taken[i][1] <= s["start"]:
            i += 1
        if s["start"] >= last and (i == len(taken) or s["end"] <= taken[i][0]):
            out.append(s)
            last = s["end"]
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def _write(weights: dict[str, float]):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = lru_cache(maxsize=100_000)(lambda pattern: chance(pattern, weights) >= ACCEPT)
        for whole in rows:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                counts, sums, spans = [], [], []
                for found in b.column(1).to_pylist():
                    base = [s for s in found if s["kind"] in BASE_KINDS]
                    everything = with_added(base, [s for s in found if s["kind"] in ADDED_KINDS and accepted(s["pattern"])])
                    text = lambda x: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x)
                    counts.append([sum(s["kind"] == k for s in base) for k in BASE_KINDS])
                    sums.append(hashlib.sha256(text(base).encode()).hexdigest())
                    spans.append(text(everything))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(sums, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return batches


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, hash of base spans, all spans."""
    with Tables(documents.sparkSession, "personal") as tables:
        found = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_find, "doc_id long, found array<struct<kind:string,start:long,end:long,pattern:string>>")
        found = tables.put(found, "spans")
        counts = tables.put(found.select(F.explode("found.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")), "patterns")
        votes = counts.groupBy(F.split("p", r"\|")[1].alias("votes")).agg(F.sum("n").alias("n")).collect()  # 27 at most
        sample = counts.orderBy(F.desc("n"), "p").limit(FIT_PATTERNS).collect()
        weights = weights_of({r["p"]: r["n"] for r in sample}, soft_labels({r["votes"]: r["n"] for r in votes}))
        out = found.mapInArrow(_write(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
        return stored(out, "personal")


def op7_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(dealt_table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii_weak": op7_pii_weak}
ORACLES: dict[str, str] = {}
