"""Template residue and error-page text, by a positive-unlabelled naive Bayes model.

Rules of high precision name trusted positive records, the seeds; every other record is unlabelled.
Expectation-maximization over passages (sentences and lines) estimates which passages are residue; the model alone
decides, on seeds too: a record is residue when such passages make up nearly all of its words. The model is one pair of
counts per hashed feature, so its size is fixed; map tasks add up their share of the counts before the shuffle, and only
the added counts reach the driver. Texts are shuffled once, to find repeated records.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shuffle_partitions, stored

#: Buckets of hashed features: bounds the model (two doubles each) at any size of the input.
BUCKETS = 1 << 18
ROUNDS = 5
#: A passage below these log odds is certainly a remark; at most OTHER of a record's words may lie in such passages.
CERTAIN = -4.0
OTHER = 0.2

# The words of the customary filler passage.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Reason phrases of HTTP status codes.
REASONS = (
    "Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Proxy Authentication Required|Request Timeout|Conflict|Gone|Length Required|"
    "Precondition Failed|(?:Content|Payload|Request Entity) Too Large|URI Too Long|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out"
)

_FIELD = r"[A-Za-z][\w .\-]{0,40}"
_UNFILLED = re.compile(
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}|[$#]\{{\s*{_FIELD}\s*\}}|%\({_FIELD}\)[sd]|%%{_FIELD}%%|@@{_FIELD}@@|\$\({_FIELD}\)|\{{%\s*{_FIELD}\s*%\}}|\[[A-Z][A-Z_.]{{2,}}\]|<TODO[^>\n]*>|\[\[{_FIELD}\]\]|<%=?\s*{_FIELD}\s*%>|__{_FIELD}__"
    rf"|\[(?i:insert|your|enter|add)\b[^\]\n]{{0,40}}\]|<(?i:insert|your|enter|add)\b[^>\n]{{0,40}}>|«{_FIELD}»|<(?!/?(?:div|p|br|span|b|i|em|strong|code|pre|a|ul|ol|li|h[1-6]|html|body|title|center|noscript|table|tr|td|hr|head|details|summary)\b){_FIELD}>|(?<![\w`$#{{]){{{_FIELD}}}"
)
_VOID = re.compile(r"\[object Object\]|\b(?:None|null|undefined|NaN|nil)\b|\(null\)|(?<![A-Za-z])N/A(?![A-Za-z])|DD/MM/YYYY|YYYY-MM-DD|MM/DD/YYYY|_{4,}|'\.{3,}'|\.{5,}|\bXXX+(?:-\d+)?\b|\bxxx+\b|\bTB[DA]\b")
_TAG = re.compile(r"</?(?:div|p|br|span|b|i|em|strong|code|pre|a|ul|ol|li|h[1-6]|html|body|title|center|noscript|table|tr|td|hr|head|details|summary)\b[^>]*>", re.I)
_TOKEN = re.compile(r"⟦\w+⟧|<!--|-->|- \[ \]|[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[?!:/]")
_IDENTIFIER = re.compile(r"`[^`\n]*`|\b[A-Za-z]+(?:[-_][A-Za-z]+)+\b(?:\(\))?|\b[a-z]+[A-Z]\w*(?:\(\))?|@[\w-]+")
_QUOTED = re.compile(r"(?<!\w)['\"“][^'\"”\n]{3,}['\"”](?!\w)")
_STATUS = re.compile(rf"^\W*(?:HTTP(?:/[\d.]+)?|Error|Fehler|Erreur)?\W*[45]\d\d\W+(?:{REASONS})\b", re.I)
_SCRIPTS = re.compile(r"\b(?:javascript|js|scripts?|script blocker|skripte|cookies)\b", re.I)
_DEMAND = re.compile(r"\b(?:enable|enabled|turn(?:ed)? (?:it )?o[nf]f?|allow(?:ed)?|requires?|required|must be on|activer|active|activar|aktivieren|attiva\w*|abilita\w*|switch (?:on|off)|benötigt|disabled|not available|ativ\w+|inschakelen)\b", re.I)
_PAGE = re.compile(r"^\W*(?:Oops!|Whoa there!|Sorry, we can.t show|Something went wrong|Traceback \(most recent call last\)|Error establishing a database|This site can.t be reached|The page you (?:are|were) looking for|The requested URL|Fehler \d{3}\b|Internal server error|Access denied\.|Access denied\W*$|HTTP ERROR\b|Proxy error\b|upstream connect error|Your session has expired|Checking your browser)", re.I)


_REFERENCE = re.compile(r"\b(?:error )?reference\W{1,3}#?\w*\d[\w.\-]*\W*$", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_ROW = re.compile(r"\s*([^\w\s])(?:\s*\1){4,}\s*$")
_QUOTE_SIGN, _CAMEL, _STOP = re.compile("['\"“]"), re.compile("[a-z][A-Z]"), re.compile(r"[.!?]\s+")
_LABEL = re.compile(r"^\W*\*\*[^*\n]{2,40}\*\*", re.M)


# Cheap tests that hold wherever the patterns of fields, void values and identifiers match.
def _may_hold_field(s: str) -> bool:
    return "{" in s or "[" in s or "<" in s or "%" in s or "@@" in s or "$" in s or "«" in s or "__" in s


def _may_hold_void(s: str) -> bool:
    return (
        "null" in s or "None" in s or "undefined" in s or "NaN" in s or "nil" in s or "[object" in s or "N/A" in s or "YYYY" in s or "____" in s or "...." in s
        or "'..." in s or "XXX" in s or "xxx" in s or "TBD" in s or "TBA" in s
    )


def _may_hold_name(s: str) -> bool:
    return "-" in s or "_" in s or "`" in s or "@" in s or _CAMEL.search(s) is not None


def _repeated(words: list[str], text: str) -> bool:
    """Filler that says one thing over and over, or consists of signs only."""
    if len({*words}) * 2 > len(words) or len(words) < 3:
        return False
    if len({*words}) == 1:
        return True
    parts = [p.strip(" .!").lower() for p in re.split(r"[.!\n]", text) if p.strip(" .!")]
    return len(parts) >= 3 and len({*parts}) == 1


def seed(text: str) -> str:
    """The family of rules that makes a record residue beyond doubt, or "": the positive examples. It decides no record.

    Rules ask for short records, as a long one may hold a remark beside the residue; what they leave out is unlabelled,
    and the model decides on it. A cheap test of signs goes before each pattern.
    """
    plain = _TAG.sub(" ", text).strip() if "<" in text else text.strip()
    if not plain or "`" in plain and _IDENTIFIER.search(plain):
        return ""
    spaced = plain.lower().split()
    if not FILLER.isdisjoint(spaced):
        words = _LETTERS.findall(plain.lower())
        if len(words) >= 4 and sum(w in FILLER for w in words) >= 0.7 * len(words):
            return "filler"
    n = len(spaced)
    if n < 60:
        if _may_hold_field(plain) and len(fields := _UNFILLED.findall(plain)) >= 2:
            return f"field {fields[0][0]}"
        if _may_hold_void(plain) and len(_VOID.findall(plain)) >= max(3, 0.2 * len(_LETTERS.findall(plain))):
            return "void"
        if _repeated(spaced, plain):
            return "repeated"
        if plain.count("<!--") >= 2 or plain[0] == "#" and plain.count("- [ ]") >= 2:
            return "form"
        if n < 45 and plain.count("**") >= 6 and len(_LABEL.findall(plain)) >= 3:
            return "label"
    if n > 25 or _QUOTE_SIGN.search(plain) and _QUOTED.search(plain):
        return ""
    if _STATUS.search(plain):
        return "status"
    if n < 20 and "reference" in plain and _REFERENCE.search(plain):
        return "reference"
    if _PAGE.search(plain):
        return f"page {spaced[0].strip('.,!')}"
    if n <= 18 and _SCRIPTS.search(plain) and (demand := _DEMAND.search(plain)) and not _IDENTIFIER.search(plain) and not re.search(r"\b(?:we|I|is needed|case)\b", plain):
        return f"scripts {demand[0].lower()}"
    return ""


def passages(text: str) -> list[str]:
    """The sentences and lines of a whole text, markup removed."""
    out = []
    for line in (_TAG.sub(" ", text) if "<" in text else text).split("\n"):
        line, start = line.strip(), 0
        for m in _STOP.finditer(line):
            k = m.start()
            if k and not line[k - 1].isdigit() and not line[k - 1].isspace():
                out.append(line[start : k + 1])
                start = m.end()
        if start < len(line):
            out.append(line[start:])
    return out


def _shaped(passage: str) -> str:
    s = _UNFILLED.sub(" ⟦field⟧ ", passage) if _may_hold_field(passage) else passage
    if _may_hold_void(s):
        s = _VOID.sub(" ⟦void⟧ ", s)
    if _QUOTE_SIGN.search(s):
        s = _QUOTED.sub(lambda m: " ⟦quote⟧ " + m[0], s)
    return _IDENTIFIER.sub(" ⟦name⟧ ", s) if _may_hold_name(s) else s


class _Tokens(dict):
    """Tokens to (hash, 0 for a word, 1 for a sign or number, 2 for a kind of place or quotation); forgets all when it has grown large."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        name = "⟦number⟧" if token.isdigit() else "⟦filler⟧" if token in FILLER and len(token) > 3 else token
        kind = 2 if name[0] == "⟦" and name != "⟦number⟧" or name in _SLOTS else 0 if name[0].isalpha() else 1
        self[token] = held = xxhash.xxh32_intdigest(name), kind, name
        return held


_SLOTS = frozenset(("⟦field⟧", "⟦void⟧", "⟦filler⟧", "<!--", "- [ ]"))
_KNOWN = _Tokens()


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


_START, _END = xxhash.xxh32_intdigest("^"), xxhash.xxh32_intdigest("$")


def features(passage: str) -> list[int]:
    """Buckets of a passage's words, word pairs and shape, each once."""
    tokens = [_KNOWN[t] for t in _TOKEN.findall(_shaped(passage).lower())]
    kinds = {kind for _, kind, _ in tokens}
    if not kinds - {1}:
        row = _ROW.match(passage)  # signs and numbers say nothing but in rows: the prior decides
        return sorted({_bucket("⟦row⟧"), _bucket(f"⟦row⟧ {row[1]}")}) if row else []
    row = [t[0] for t in tokens]
    found = {h % BUCKETS for h in row}
    if 2 in kinds:
        names = [t[2] for t in tokens]
        found.update(_bucket(f"{k} {min(3, names.count(k))}") for k in {*names} if k[0] == "⟦")
        slots = sum(t in _SLOTS for t in names)
        if slots:  # what the kinds of unfilled places have in common
            found.add(_bucket(f"⟦slots⟧ {min(3, slots)} of {min(3, 4 * slots // len(tokens))}"))
    if len(row) >= 3 and len({*row}) == 1:
        found.add(_bucket("⟦repeat⟧"))
    found.update([(x * 0x9E3779B1 + y >> 9) % BUCKETS for x, y in zip([_START, *row], [*row, _END])])
    return sorted(found)


def _featured(without: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record: whether it is a seed, and its passages' words, numbers of features and features.

    A passage that a task has seen isn't read again.
    """
    seen: dict[str, tuple[int, list[int]]] = {}
    for batch in batches:
        sure, words, sizes, flat = [], [], [], []
        for body in batch.column("body").to_pylist():
            family = seed(body)
            sure.append(family != "" and family not in without)
            w, n, f = [], [], []
            for p in passages(body):
                held = seen.get(p)
                if held is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    held = seen[p] = max(1, len(p.split())), features(p)
                w.append(held[0]), n.append(len(held[1])), f.extend(held[1])
            words.append(w), sizes.append(n), flat.append(f)
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (words, sizes, flat)]
        yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(sure, pa.bool_()), *lists], ["record", "sure", "words", "sizes", "features"])


def _log_odds(model: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Of each passage of a batch, under the model: the log odds of each bucket, its last entry the prior."""
    total = np.r_[0.0, np.cumsum(model[batch.column("features").flatten().to_numpy()])]
    ends = np.cumsum(batch.column("sizes").flatten().to_numpy())
    return total[ends] - total[np.r_[0, ends[:-1]]] + model[-1] if len(ends) else np.zeros(0)


def _expected(model: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's share of the M step: expected counts of each bucket among residue, and at first among all passages."""
    counts = np.zeros((2, BUCKETS + 1))
    for batch in batches:
        sizes = batch.column("sizes")
        sure = np.repeat(batch.column("sure").to_numpy(zero_copy_only=False).astype(float), np.diff(sizes.offsets.to_numpy()))
        flat, n = batch.column("features").flatten().to_numpy(), sizes.flatten().to_numpy()
        residue = sure if model is None else np.where(sure > 0, 1.0, 1 / (1 + np.exp(-np.clip(_log_odds(model, batch), -30, 30))))
        some = residue > 1e-6  # most passages are certainly remarks
        counts[0, :-1] += np.bincount(flat[np.repeat(some, n)], np.repeat(residue[some], n[some]), BUCKETS)
        counts[0, -1] += residue.sum()
        if model is None:
            counts[1, :-1] += np.bincount(flat, minlength=BUCKETS)
            counts[1, -1] += len(n)
    used = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "residue", "all"])


def _fitted(residue: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Log odds of each bucket (a passage has it or not), and of the prior, from the expected counts."""
    counts = np.stack([residue, np.maximum(every - residue, 0.0)])
    total = counts[:, -1] + 1
    rate = (counts[:, :-1] + 0.02) / total[:, None]
    share = np.clip(total[0] / total.sum(), 1e-6, 0.5)
    return np.r_[np.log(rate[0] / rate[1]), np.log(share / (1 - share))]


def fit(records: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximization over the passages of all records: those of seeds are residue, those of others are unlabelled."""
    spark, model, every = records.sparkSession, None, None
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)
        step = records.select("sure", "sizes", "features").mapInArrow(lambda batches, held=held: _expected(held.value, batches), "bucket int, residue double, all double")
        counts = np.zeros((2, BUCKETS + 1))
        for bucket, residue, of_all in step.groupBy("bucket").agg(F.sum("residue"), F.sum("all")).collect():
            counts[:, bucket] = residue, of_all
        every = counts[1] if model is None else every
        model = _fitted(counts[0], every)
    return model


def _decided(model: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record's sum of log odds over its passages, and the share of its words in passages that are certainly remarks."""
    for batch in batches:
        odds, words = _log_odds(model, batch), batch.column("words").flatten().to_numpy().astype(float)
        ends = batch.column("words").offsets.to_numpy()
        ends = ends - ends[0]
        sums = [np.r_[0.0, np.cumsum(x)] for x in (odds, words, np.where(odds < CERTAIN, words, 0.0))]
        total, all_words, remarks = (x[ends[1:]] - x[ends[:-1]] for x in sums)
        yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(total), pa.array(remarks / np.maximum(all_words, 1))], ["record", "log_odds", "other"])


def score_records(records: DataFrame, key: str, body: str, without: frozenset[str] = frozenset()) -> DataFrame:
    """(key, log_odds, other): the sum over a record's passages, the share of words in certain remarks.

    Null and blank bodies have no passage and give no row; repeated rows of a key are taken once (the least body);
    other columns are ignored. An empty table gives no row. without: families of seeds that are left unlabelled, to
    measure what the model finds of kinds that no rule names.
    """
    n = shuffle_partitions(records.sparkSession)
    keyed = records.filter(F.col(body).rlike(r"\S") & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("record"), F.col(body).alias("body"))
    bodies = keyed.repartition(n, "record").groupBy("record").agg(F.min("body").alias("body"))
    rows = stored(bodies.mapInArrow(lambda batches: _featured(without, batches), "record long, sure boolean, words array<int>, sizes array<int>, features array<int>"))
    held = records.sparkSession.sparkContext.broadcast(fit(rows))
    return rows.select("record", "words", "sizes", "features").mapInArrow(lambda batches: _decided(held.value, batches), "record long, log_odds double, other double").withColumnRenamed("record", key)


def find_residue(records: DataFrame, key: str, body: str) -> DataFrame:
    """Keys of the records that are residue as a whole, as the model decides."""
    return score_records(records, key, body).filter((F.col("log_odds") > 0) & (F.col("other") <= OTHER)).select(key)
