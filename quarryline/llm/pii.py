"""Personal information inside free text, by weak supervision.

Candidates are generous: whatever has the form of an address, number or name. Regex, gazetteer and context labelers vote
for or against each (or abstain). Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and gives every pattern a probability. On the spans of which that is sure a classifier over hashed word and
shape features, which sees no votes, is trained; both together decide, and either can overrule the other. Texts are
searched once, where they lie, and stored with their spans; what is shuffled are counts, added up before the shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread, stored
from .vocabulary import TOKENIZERS, load, whole_words

TYPES = ("email", "address", "id_number", "phone", "name")
#: Bits of the hashed gazetteer of name words, and buckets of hashed features: both bound what is broadcast.
GAZETTEER_BITS, BUCKETS = 1 << 22, 1 << 14
EM_ROUNDS = 40
#: Spans whose probability is at most so far from 0 or 1 train the classifier; bounds of what each side says in the end.
SURE, VOTES_CLIP, WORDS_CLIP = 0.1, 4.0, 6.0
#: What one feature counts: features of a span depend on each other.
FEATURE = 0.3
ABSTAIN, FOR, AGAINST = 0, 1, 2

_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŻŠŽČ", "a-zß-öø-ÿłśżšžčěřůńćęąğışő"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]")

_EMAIL = re.compile(r"(?<![\w.+\-@])[\w][\w.+\-]*@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}(?![\w])")
_SPELT = re.compile(r"(?<![\w.+\-])[\w][\w.+\-]*(?:\s?[(\[{<]\s?at\s?[)\]}>]\s?[\w\-]+(?:\s?(?:[(\[{<]\s?dot\s?[)\]}>]|\.|\sdot\s)\s?[\w\-]+)+|\sat\s[\w\-]+(?:\s?[(\[{<]?\s?\bdot\b\s?[)\]}>]?\s?[\w\-]+)+)(?![\w])", re.I)
#: Every match of the two holds one of these.
_AT = re.compile(r"@|\bat\b", re.I)
_PHONE = re.compile(r"(?<![\w.@/:#\-])(?:\+\d|\(\d|\d)[\d ().\-]{4,}\d(?:,?\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?(?![\w\-])")
_PHONE_FORM = re.compile(r"^(?:\+\d{1,3}[ .\-(]+[\d ().\-]{6,}|00\d{1,3}?[ .\-(]+[\d ().\-]{6,}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[\-. ]\d{3}[\-. ]\d{4}|\d{3}-\d{4}|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,5})(?:,?\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?$")
_NUMBER = re.compile(
    r"(?<![\w\-.])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{8}-[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?:\d{4}[ \-]?){3}\d{4}|\d{9}|\d{7,8}[A-Z])(?![\w\-])"
)
_NUMBER_FORM = re.compile(r"^(?:\d{3}-\d{2}-\d{4}|\d{8}-[A-Z]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]{1,2}\d{7,9}|ZZ\d{6}|\d{2} \d{3} \d{3} \d{3})$")
_NUMBER_WORD = re.compile(r"(?:ssn|social security|passport|reisepass|pasaporte|passeport|national id|identity|id card|ausweis\w*|dni|nif|licen[cs]e|führerschein\w*|tax ?id|tin|steuer\w*|ni number|insurance|iban|account number|card number)\W*(?:no\b|nr\b|number|nummer|is|:|#)*\W*$", re.I)
_NUMBER_AFTER = re.compile(r"^\W{0,3}\(?(?:ssn|passport|tax ?id|national id)\b", re.I)
_TECHNICAL = re.compile(r"\b(?:ports?|block|request|epoch|error|id column|column holds|commit|sha|hash|version|build|trace|listens|reserved|offset|bytes?|ms|0x|section|ticket|line|rows?)\b[^.!?\n]{0,12}$", re.I)
_KIND = r"(?:street|road|avenue|ave|lane|close|crescent|blvd|boulevard|drive|court|way|place|square|terrace|gardens|hill|rd|ln|dr)"
_TOWN = rf"[{_UP}][{_LOW}]+(?:[ \-][{_UP}][{_LOW}]+)?"
_ADDRESS = re.compile(
    rf"(?<![\w.\-])(?:(?i:flat|apt|unit|apartment)\.? \d+[a-z]?,? )?\d{{1,5}}[a-z]?,? (?:[{_UP}{_LOW}][\w'’\-]*[ ]){{1,2}}(?i:{_KIND})\b\.?(?:,? (?i:flat|apt|unit|apartment)\.? \d+[a-z]?)?(?:, {_TOWN}(?: \d{{4,5}})?)?"
    rf"|(?<![\w.\-])(?:[{_UP}][{_LOW}]+[ \-])?[{_UP}{_LOW}][{_LOW}]*(?i:straße|strasse|gasse|weg|platz|allee|ring)[ ]\d{{1,4}}[a-z]?\b(?:, \d{{4,5}} {_TOWN}| in {_TOWN}|, {_TOWN})?"
    rf"|(?<![\w.\-])\d{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:de |du |des |la |le )*{_TOWN}(?:, \d{{5}} {_TOWN})?|(?<![\w.\-])(?:Calle|Avenida|Plaza|Paseo) (?:de |del |la )*{_TOWN},? \d{{1,4}}(?:, (?:\d{{5}} )?{_TOWN})?"
)
_ADDRESS_WORD = re.compile(r"(?:lives at|ship(?:ped)? \w* ?\w* ?\w* ?to|deliver\w* to|address(?: is)?\W*|contains|invoice[^,]{0,40}|rechnung an [^,]{0,60},|,|/|at|to|home)\W*$", re.I)
_CAPITAL = rf"[{_UP}][{_LOW}'’]*[{_LOW}](?:-[{_UP}][{_LOW}]+)?"
_NAME = re.compile(
    rf"(?<![\w@\-/.`$#{{])(?:{_CAPITAL}, (?!Tel\b)(?:{_CAPITAL}|[{_UP}]\.)|(?:[{_UP}]\. )?{_CAPITAL}(?: (?:[{_UP}]\.|(?:van|von|de|der|al|bin|del) {_CAPITAL}|{_CAPITAL})){{0,2}}|[{_UP}]{{3,}}(?: [{_UP}]{{3,}}){{1,2}})(?![\w@\-/`]|\.\w|\()"
)
_SMALL = re.compile(rf"(?<![\w@\-/.`$#])(?=([{_LOW}]{{2,}},? [{_LOW}]{{3,}})(?![\w@\-/`]|\.\w|\())")
_SMALL_ONE = re.compile(rf"(?<![\w@\-/.`$#])(?:[{_LOW}]\. )?[{_LOW}]{{3,}}(?: [{_LOW}]\.)?(?![\w@\-/`]|\.\w|\()")
_LOWER = re.compile(rf"[{_LOW}]{{3,}}")
_LOWER_INITIAL = re.compile(rf"(?<!\w)[{_LOW}]\. [{_LOW}]{{3}}|[{_LOW}]{{3}} [{_LOW}]\.")
_TRAILER = re.compile(r"(?:^|\n)[ >]*[A-Za-z\-]+-by: *$")
_BEFORE = re.compile(
    r"(?:[a-z]-by: *|\b(?:agreed with|thanks to|ask for|asked|escalate to|kontakt:|contact:?|per|tested by|rechnung an|reported by|paired with|spoke (?:to|with)|talked (?:to|with)|from support:|customer|colleague|dear|hi|hello|cc|grüße,|regards,|merci à|gracias a|danke(?: an)?|according to|owner:|author:|assignee:|signed,?|by) *)$",
    re.I,
)
_AFTER = re.compile(r"^(?: *<[\w.+\-]+@|['’]s (?:request|passport|driver|ssn|national|tax|ni number|my ssn|\d)|, (?:who|passport|national id|tax id|ni number|driver|ssn|my ssn|tel\b|\+?\(?\d|mailto:|[\w.+\-]+(?:@| ?[(\[]at[)\]]| at ))| (?:lives at|said|reviewed|has left|wants|called|told me|asked|wrote|thinks|prefers|suggested)\b|', '|, <)", re.I)
_WEEK = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())


@dataclass
class Span:
    start: int
    end: int
    kind: str
    votes: tuple[int, ...]
    features: list[int] = field(default_factory=list)


class Labelers:
    """Finds candidate spans and lets the labelers vote."""

    def __init__(self, bits: np.ndarray, vocabularies: dict[str, bytes] | None = None) -> None:
        self.bits = bits
        self.memo: dict[str, bool] = {}
        self.ordinary = {w for w in whole_words(vocabularies or load()) if w.islower()}

    def listed(self, word: str) -> bool:
        """Whether the gazetteer has the word."""
        held = self.memo.get(word)
        if held is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            h = xxhash.xxh64_intdigest(word.lower().encode(), 42) % GAZETTEER_BITS
            held = self.memo[word] = bool(int(self.bits[h >> 6]) >> (h & 63) & 1)
        return held

    def spans(self, text: str) -> list[Span]:
        """Candidates of a whole text, those of an earlier type first; a likely one blocks later ones that overlap."""
        found: list[Span] = []
        digits = any(c.isdigit() for c in text)

        def add(kind: str, start: int, end: int, *votes: int) -> None:
            if all(end <= s.start or start >= s.end for s in found if s.votes.count(FOR) > s.votes.count(AGAINST)):
                found.append(Span(start, end, kind, votes))

        if _AT.search(text):
            for m in _EMAIL.finditer(text):
                before, after = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 12]
                remote = m[0].lower().startswith("git@") or after.startswith(":") and re.match(r":[\w./\-]+/", after) is not None or "://" in before[-12:]
                cue = before.endswith(("<", "mailto:", "MAILTO:", "('", ", '", '"')) or re.search(r"-by:|reach|mail|contact|recipient|support|ping|nda|escalate", text[max(0, m.start() - 60) : m.start()], re.I)
                add("email", m.start(), m.end(), FOR, AGAINST if remote else ABSTAIN, AGAINST if remote else FOR if cue else ABSTAIN, AGAINST if remote else FOR)
            for m in _SPELT.finditer(text):
                plain = re.search(r"[(\[{<]\s?at", m[0], re.I) is None
                last = re.split(r"\W+", m[0])[-1].lower()
                add("email", m.start(), m.end(), ABSTAIN if plain else FOR, FOR, FOR if last in ("example", "test", "local", "com", "org", "net", "de", "fr", "es", "io", "invalid") else ABSTAIN, ABSTAIN)
        if digits:
            for m in _ADDRESS.finditer(text):
                words = re.findall(r"[^\W\d_]+", m[0])
                before = text[max(0, m.start() - 60) : m.start()]
                middle = words[1:-1] if words and words[0].lower() in ("flat", "apt", "unit", "apartment") else words[:1]
                cue = _ADDRESS_WORD.search(before)
                common = not cue and all(w.lower() in self.ordinary and w.islower() for w in middle)
                technical = re.search(r"\b(?:section|rows?|port|line|version)\W*$", before[-14:], re.I)
                add("address", m.start(), m.end(), AGAINST if common else FOR, FOR if cue else ABSTAIN, AGAINST if technical or common else ABSTAIN, FOR if "," in m[0] or re.search(r" in [A-Z]", m[0]) else ABSTAIN)
            for m in _NUMBER.finditer(text):
                before = text[max(0, m.start() - 40) : m.start()]
                named = _NUMBER_WORD.search(before) or _NUMBER_AFTER.search(text[m.end() : m.end() + 20])
                technical = not named and _TECHNICAL.search(before)
                shaped = _NUMBER_FORM.match(m[0])
                bare = m[0].isdigit()
                add("id_number", m.start(), m.end(), FOR if shaped else AGAINST if bare else ABSTAIN, FOR if named else AGAINST if technical else ABSTAIN, AGAINST if technical else ABSTAIN, FOR if named and any(c.isalpha() for c in m[0]) or shaped and not technical else ABSTAIN if named else AGAINST)
            for m in _PHONE.finditer(text):
                start, end = m.start(), m.end()
                n = sum(c.isdigit() for c in re.split(r"(?:ext|x|Durchwahl)", m[0])[0])
                before = text[max(0, start - 40) : start]
                if not 7 <= n <= 15 or re.match(r"^\d{4}-\d\d-\d\d", m[0]) or re.match(r"^\d+(?:\.\d+){2,3}$", m[0]) and n < 10:
                    continue
                form = _PHONE_FORM.match(m[0]) is not None
                plain = m[0].isdigit()
                cue = re.search(r"\b(?:call|called|phone|tel|mobile|cell|number|text message to|fax|reach|ping me|whatsapp|picks this up|try|contains|and|or|customer)\b[^\n]{0,16}$", before, re.I) or re.match(r"[^\n]{0,24}\b(?:mobile|ask for|pager|angry|never arrived)\b", text[end : end + 40], re.I)
                technical = _TECHNICAL.search(before) and not re.search(r"\b(?:call|tel|phone)", before, re.I)
                add("phone", start, end, FOR if form else AGAINST if plain else ABSTAIN, FOR if cue and not technical else ABSTAIN, AGAINST if technical else ABSTAIN, AGAINST if plain or not form else FOR)
        for m in _NAME.finditer(text):
            end = m.end()
            if ", " in m[0] and any(s.start < end and s.end > m.start() for s in found):
                end = m.start() + m[0].index(",")  # what follows the comma is an address
            self._name(text, m.start(), end, add)
        if any(self.listed(w) and w not in self.ordinary for w in _LOWER.findall(text)) or _LOWER_INITIAL.search(text):
            for m in _SMALL.finditer(text):
                words = m[1].replace(",", "").split()
                if all(self.listed(w) for w in words) and not all(w in self.ordinary for w in words):
                    self._name(text, m.start(1), m.end(1), add)
            for m in _SMALL_ONE.finditer(text):
                if m[0] not in self.ordinary and self.listed(max(re.findall(r"[^\W\d_]+", m[0]), key=len)) and (_BEFORE.search(text[max(0, m.start() - 30) : m.start()]) or _AFTER.search(text[m.end() : m.end() + 30])):
                    self._name(text, m.start(), m.end(), add)
        for s in found:
            s.features = self._features(text, s)
        return found

    def _name(self, text: str, start: int, end: int, add) -> None:
        words = [w for w in re.findall(r"[^\W\d_]+", text[start:end])]
        while len(words) > 1 and words[0].lower() in self.ordinary and not self.listed(words[0]) and words[0][1:].islower() and re.match(r"[^\W\d_]+ ", text[start:end]):
            start += len(words.pop(0)) + 1  # a sentence's first word before a name
        long = [w for w in words if len(w) > 1]
        if not long or all(w.lower() in _WEEK for w in long) or len({w.lower() for w in long}) < len(long):
            return  # nobody has the same name twice
        usual = [w.lower() in self.ordinary for w in long]
        listed = [self.listed(w) for w in long]
        before, after = text[max(0, start - 40) : start], text[end : end + 40]
        cue, follows = _BEFORE.search(before), _AFTER.search(after)
        if all(usual) and not any(listed) and not cue and not follows:
            return  # ordinary words that nothing speaks for
        code = re.search(r"[`$]\w*$|(?:section|the|a|an|of|in|from|with|every|our)\s$", before, re.I)
        add(
            "name", start, end, FOR if all(listed) else ABSTAIN if any(listed) else AGAINST, FOR if cue else ABSTAIN, FOR if follows else ABSTAIN,
            AGAINST if all(usual) else FOR if len(long) > 1 and not any(usual) else ABSTAIN, AGAINST if code and not cue and not follows else ABSTAIN,
        )

    def _features(self, text: str, s: Span) -> list[int]:
        shape = re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"\d", "0", text[s.start : s.end])))[:24]
        before = [w.lower() for w in _WORD.findall(text[max(0, s.start - 40) : s.start])[-3:]]
        after = [w.lower() for w in _WORD.findall(text[s.end : s.end + 30])[:2]]
        opens = s.start == 0 or text[max(0, s.start - 8) : s.start].rstrip(" >*_-")[-1:] in (".", "!", "?", "\n", "")
        found = [f"s {shape}", f"o {opens} {' ' in text[s.start : s.end]}", *(f"b{k} {w}" for k, w in enumerate(reversed(before))), *(f"a{k} {w}" for k, w in enumerate(after)), "b " + " ".join(before[-2:])]
        return sorted({xxhash.xxh32_intdigest(f"{s.kind} {f}") % BUCKETS for f in found})


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Probability that spans of each vote pattern are cases, by expectation-maximisation over labeler reliabilities.

    Votes of a labeler given the truth are taken as independent of the others'. It starts from the majority.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    votes, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    margin = (votes == FOR).sum(1) - (votes == AGAINST).sum(1)
    p = 1 / (1 + np.exp(-2.0 * margin))
    start = p.copy()
    for _ in range(rounds):
        share = np.clip((n @ p + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4)
        odds = np.full(len(keys), math.log(share / (1 - share)))
        for k in range(votes.shape[1]):
            for value in (FOR, AGAINST):  # to abstain says nothing
                at = votes[:, k] == value
                cast = votes[:, k] != ABSTAIN
                rate = [(n[at] @ q[at] + (1.6 if good else 0.4)) / (n[cast] @ q[cast] + 2) for q, good in ((p, value == FOR), (1 - p, value == AGAINST))]
                odds[at] += math.log(rate[0] / rate[1])
        p = 1 / (1 + np.exp(-np.clip(odds + np.log(start / (1 - start)) * 0.5, -12, 12)))
    return dict(zip(keys, p.tolist()))


#: Names of organisations and of accounts that nobody in person has; their words are left out of the gazetteer.
ORGANISATION = r"(?i)\b(?:the|team|gmbh|ltd|llc|inc|ag|kg|corp|bot|your|name|user|root|admin\w*|unknown|nobody|ci|build\w*|no-?reply|test)\b"
_PATTERNS = 3**5


def _code(votes: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def _votes(code: int) -> tuple[int, ...]:
    return tuple(code // 3**k % 3 for k in range(5))


@dataclass
class Model:
    """What EM and training give: log odds by type and vote pattern, and by type and feature bucket."""

    patterns: np.ndarray
    weights: np.ndarray

    def accepts(self, kinds: np.ndarray, votes: np.ndarray, sizes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Of each span whether it is a case; sizes: its number of features."""
        total = np.r_[0.0, np.cumsum(self.weights[np.repeat(kinds, sizes), features])]
        ends = np.cumsum(sizes)
        words = total[ends] - total[ends - sizes]
        return np.clip(self.patterns[kinds, votes], -VOTES_CLIP, VOTES_CLIP) + np.clip(words, -WORDS_CLIP, WORDS_CLIP) > 0


def gazetteer(names: DataFrame, name: str) -> np.ndarray:
    """A fixed-size bit set of the words of all people's names, added up in Spark; at most GAZETTEER_BITS / 64 rows are collected."""
    people = names.filter(~F.col(name).rlike(ORGANISATION))
    words = people.select(F.explode(F.split(F.lower(name), r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 3).distinct()
    h = F.pmod(F.xxhash64("w"), F.lit(GAZETTEER_BITS))
    packed = words.select(F.shiftright(h, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(w), {GAZETTEER_BITS}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(GAZETTEER_BITS >> 6, np.uint64)
    for at, value in packed.collect():
        bits[at] = value & 0xFFFFFFFFFFFFFFFF
    return bits


_LISTS = ("starts", "ends", "kinds", "votes", "sizes", "features")


def search(bodies: DataFrame, labelers) -> DataFrame:
    """(source_table, record_key, body) with the spans of each body: their ends, types, votes as a number, and features."""

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = labelers(), {k: i for i, k in enumerate(TYPES)}
        for batch in batches:
            found = [known.spans(text) for text in batch.column("body").to_pylist()]
            columns = (
                [[s.start for s in x] for x in found], [[s.end for s in x] for x in found], [[at[s.kind] for s in x] for x in found], [[_code(s.votes) for s in x] for x in found],
                [[len(s.features) for s in x] for x in found], [[f for s in x for f in s.features] for x in found],
            )
            kept = ["source_table", "record_key", "body"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], [*kept, *_LISTS])

    return bodies.select("source_table", "record_key", "body").mapInArrow(voted, "source_table string, record_key string, body string, " + ", ".join(f"{c} array<int>" for c in _LISTS))


def _flat(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy() for c in columns]


def train(spans: DataFrame) -> Model:
    """Vote patterns are counted, EM turns counts into probabilities, and of the spans that it is sure of features are weighted.

    A weight is shrunk towards none where a class has few spans, so a type without cases or without others has none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TYPES) * _PATTERNS, np.int64)
        for batch in batches:
            kinds, votes = _flat(batch, "kinds", "votes")
            total += np.bincount(kinds * _PATTERNS + votes, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    counts: dict[int, dict[tuple[int, ...], int]] = {}
    for at, n in spans.select("kinds", "votes").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        counts.setdefault(at // _PATTERNS, {})[_votes(at % _PATTERNS)] = n
    soft = np.full((len(TYPES), _PATTERNS), 0.5)
    for kind, held in counts.items():
        for votes, p in estimate(held).items():
            soft[kind, _code(votes)] = min(max(p, 1e-6), 1 - 1e-6)
    sent = spans.sparkSession.sparkContext.broadcast(soft)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(TYPES) * (BUCKETS + 1)))
        for batch in batches:
            kinds, votes, sizes, features = _flat(batch, "kinds", "votes", "sizes", "features")
            p = sent.value[kinds, votes]
            sure = (p < SURE) | (p > 1 - SURE)
            for k, weight in enumerate((p * sure, (1 - p) * sure)):
                total[k] += np.bincount(kinds * (BUCKETS + 1) + BUCKETS, weight, total.shape[1])
                total[k] += np.bincount(np.repeat(kinds, sizes) * (BUCKETS + 1) + features, np.repeat(weight, sizes), total.shape[1])
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0, at]), pa.array(total[1, at])], ["at", "good", "bad"])

    sums = np.zeros((2, len(TYPES) * (BUCKETS + 1)))
    for at, good, bad in spans.select("kinds", "votes", "sizes", "features").mapInArrow(weighed, "at long, good double, bad double").groupBy("at").agg(F.sum("good"), F.sum("bad")).collect():
        sums[:, at] = good, bad
    sums = sums.reshape(2, len(TYPES), BUCKETS + 1)
    share = sums[:, :, -1:] + 1
    share = share / share.sum(0)
    weights = np.log(sums[0, :, :-1] + share[0]) - np.log(sums[1, :, :-1] + share[1]) - np.log(share[0] / share[1])
    return Model(np.log(soft / (1 - soft)), np.clip(weights, -3, 3) * FEATURE)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a typed placeholder for each span."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s.start):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
    return "".join(out) + text[at:]


def _decided(records: DataFrame, names: DataFrame, name: str, tokenizers: str, texts: bool) -> DataFrame:
    bodies = spread(records.filter(F.col("body").rlike(r"\S")).select("source_table", "record_key", "body"))
    sent = records.sparkSession.sparkContext.broadcast((gazetteer(names, name), load(tokenizers)))
    spans = stored(search(bodies, lambda: Labelers(*sent.value)))
    model = records.sparkSession.sparkContext.broadcast(train(spans))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, kinds, votes, sizes, features = _flat(batch, *_LISTS) if texts else [None, None, *_flat(batch, *_LISTS[2:])]
            good = model.value.accepts(kinds, votes, sizes, features)
            cuts = batch.column("kinds").offsets.to_numpy()
            cuts = (cuts - cuts[0]).tolist()
            types, bodies = [], []
            for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
                at = [i for i in range(low, high) if good[i]]
                types.append(sorted({TYPES[kinds[i]] for i in at}))
                if texts:
                    text = batch.column("body")[k].as_py()
                    bodies.append(redact(text, [Span(int(starts[i]), int(ends[i]), TYPES[kinds[i]], ()) for i in at]) if at else text)
            out = [batch.column("source_table"), batch.column("record_key"), pa.array(types, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(bodies, pa.string())] if texts else out, ["source_table", "record_key", "types", "redacted"][: 3 + texts])

    columns = ("source_table", "record_key", "body", *_LISTS) if texts else ("source_table", "record_key", *_LISTS[2:])
    return spans.select(*columns).mapInArrow(found, "source_table string, record_key string, types array<string>" + ", redacted string" * texts)


def find_types(records: DataFrame, names: DataFrame, name: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(source_table, record_key, types) as find_pii gives, without reading the texts again."""
    return _decided(records, names, name, tokenizers, False)


def find_pii(records: DataFrame, names: DataFrame, name: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(source_table, record_key, types, redacted): each row's types of personal data, and its text with placeholders.

    records: (source_table, record_key, body). Null and blank bodies give no row; repeated rows stay. names has a
    column of people's names, for the gazetteer; nulls and names of organisations in it are ignored.
    """
    return _decided(records, names, name, tokenizers, True)


def bodies_of(commits: DataFrame, comments: DataFrame) -> DataFrame:
    """(source_table, record_key, body) of both tables."""

    def part(df: DataFrame, table: str, key: Column) -> DataFrame:
        return df.select(F.lit(table).alias("source_table"), key.alias("record_key"), "body")

    return part(commits, "commits", F.col("hash")).unionByName(part(comments, "review_comments", F.col("comment_id").cast("string")))
