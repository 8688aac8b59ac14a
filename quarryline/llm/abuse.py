"""Abusive, hateful or sexual content.

A weighted Levenshtein automaton for each word that no public vocabulary holds is intersected with a trie of terms:
words of a lexicon and words that tell harmful from harmless samples. A letter more, less, other, or two neighbours
exchanged costs one, anywhere in a word; signs and digits that stand for letters, separators and stretched letters cost
nothing. So misspelled and disguised terms are read as the term. A hit counts by its term's weight and by the words
around it: context weights, learned from a bounded set of hand-labelled samples, tell abuse from quotation, rules,
technical uses and swearing at code. Sentences without a lexicon term count by what was learned from the samples about
words and word pairs, once the automaton finds a word that is typical of harmful ones. Documents are scored where they
lie, without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .vocabulary import TOKENIZERS, load, whole_words

#: Labelled samples that the context weights are fitted on at most.
SAMPLES = 5_000
#: Words on either side of a hit that make its context; bounds of one word's weight and of a context.
WINDOW, WORD_CLIP, CONTEXT_CLIP = 8, 1.2, 5.0
#: Score from which a document counts as a case, and what the learned odds of a sentence must exceed to count at all.
THRESHOLD, EVIDENCE = 1.5, 6.0

# Terms by class and weight. 3 needs little context, 2 some, 1 much; 4 are idioms, enough alone. An idiom may have one
# other word between its words; + joins its anchor, the word that is looked up first. Accents are folded.
LEXICON: dict[tuple[str, float], str] = {
    ("abusive", 3.0): (
        "idiot idiots moron morons imbecile imbeciles halfwit halfwits dimwit dimwits cretin cretins scumbag scumbags bastard bastards dumbass asshole assholes retard twat wanker stfu fuck fucking fucker bitch dickhead jackass nitwit "
        "vollpfosten vollidiot arschloch wichser drecksack trottel fresse abruti abrutis minable connard salaud imbecil idiota idiotas gilipollas cabron pendejo estupido inutil dummkopf hurensohn versager basura"
    ),
    ("abusive", 2.0): "brainless spineless worthless pathetic repulsive miserable disgusting disgrace useless crap verpiss kotzt creve degage callate asco mierda dumbest stupidest",
    ("abusive", 2.5): "loser losers clown clowns parasite parasites schwachkopf payaso payasos clochard",
    ("abusive", 1.0): "dumb stupid ugly garbage hate damn die kill ashamed lazy fat thick rubbish idiotic",
    ("abusive", 4.0): (
        "go to +hell|go +die|+kill yourself|+hang yourself|+shut up you|waste of +space|cry me a +river|nobody likes +you|you'll regret the +day|+watch your back|we know where you +live|i will +hurt you|find out where you +live|break your +legs|hope you +choke|+stop breathing|"
        "+punch in the face|+jump off a bridge|+hau ab|geh +sterben|halt die +fresse|halt die +klappe|scher dich zum +teufel|zu +dumm zum atmen|zu +blod zum atmen|va +crever|ta +gueule|+fous le camp|va au +diable|+vete al diablo|vete al +infierno|que te +mueras|das +asco"
    ),
    ("hateful", 3.0): "subhuman subhumans vermin savages untermensch untermenschen ungeziefer minderwertig vermine vermines parasitos alimanas racaille abschaum infrahumanos sous-hommes",
    ("hateful", 2.0): "thieves liars filth plague sewer primitive breed rats animals raza ladrones auslander etrangers extranjeros gesindel",
    ("hateful", 1.0): "women foreigners ausland frauen femmes mujeres inmigrantes immigrants muslims jews gays blacks gypsies",
    ("hateful", 4.0): "back where they +came from|+get rid of all|lower +kind of human|+disgusting breed|gehoren nicht +hierher|haben hier +nichts verloren|raza de +ladrones|+fuera de aqui|dans leur +sang",
    ("sexual", 3.0): "porn porno nude nudes naked boobs tits breasts horny orgasm climaxed blowjob erotic sexy nackt desnuda desnudo nue nus nuda uncensored undress moaned xxx milf cock pussy webcam deshabiller deshabille desnudarte nacktbilder nacktfotos geiles geile ausziehen",
    ("sexual", 2.0): "thighs unbuttoned stripped lick amateurs singles lips nackte clothes lap bed topless lingerie kissed cama ropa groaning moaning sweating",
    ("sexual", 1.0): "sex strip adult suck private members intimate body skin",
    ("sexual", 4.0): "hot +singles|adult +content|be +inside you|get you into +bed|sit on my +lap|without your +clothes|take off your +clothes|+strip for me|zieh dich +aus|ganz +nackt|+sin ropa|en mi +cama|dans mon +lit|dans ton +lit|mit mir ins +bett|in meinem +bett|spread your +legs|on your +knees|send +pics",
}

#: Letters that a sign, digit or letter of like sound may stand for.
_SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "k": "c", "z": "s"}
_SEPARATORS = frozenset("-_.·")
_LOOKALIKE = str.maketrans("асеорхуікмтвнѕјԁɡαορυικ", "aceopxyikmtbhsjdgaopuik")
_HIDDEN = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_TOKEN = re.compile(r"[A-Za-z0-9@$*!|€]*[A-Za-z@$*][A-Za-z0-9@$*|€]*(?:'[A-Za-z]+)?(?:[-_.][A-Za-z0-9*@$]+)*|[^\W\d_]+|['\"“”‘’`«»<>]")
_SPACED = re.compile(r"(?<![\w'])(?:[A-Za-z0-9@$*][ .\-_*·]{1,2}){2,}[A-Za-z0-9@$*](?![\w'])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_STRETCH = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1")
_QUOTES = frozenset("'\"“”‘’`«»")


def fold(text: str) -> str:
    """Lower case without accents, hidden characters and letters of other scripts that look alike."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text)).lower().translate(_LOOKALIKE).replace("’", "'").replace("ß", "ss")
    return "".join(c for c in text if not unicodedata.combining(c))


class Trie:
    """Terms, searched with weighted Levenshtein automata."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        """(cost, term) within the cost. A state of the automaton is a pair of rows of bounded costs; it reads the trie's
        letters, and rows above the bound everywhere end the branch. A letter more, less, other, or two neighbours
        exchanged cost one; * stands for any letter, signs for the letters they look like; separators and further letters of a run of three or more cost nothing."""
        n = len(word)
        stands = [_SIGNS.get(w, "") for w in word]
        free = [w in _SEPARATORS or j >= 1 and word[j - 1] == w and word[max(0, j - 2) : j + 2].count(w) >= 3 for j, w in enumerate(word)]
        first = [0]
        for j in range(n):
            first.append(first[-1] + (not free[j]))
        found = []
        stack: list[tuple[dict, list[int], list[int] | None, str]] = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        found.append((row[-1], child))
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    w = word[j - 1]
                    cost = row[j - 1] if w == c or w == "*" or c in stands[j - 1] else row[j - 1] + 1
                    more = new[-1] if free[j - 1] else new[-1] + 1
                    if more < cost:
                        cost = more
                    if row[j] + 1 < cost:
                        cost = row[j] + 1
                    if before is not None and j > 1 and w == last and word[j - 2] == c and w != c and before[j - 2] + 1 < cost:
                        cost = before[j - 2] + 1
                    new.append(cost)
                if min(new) <= most or min(row) < most:  # an exchange reaches two rows back
                    stack.append((child, new, row, c))
        return sorted(found)


class Matcher:
    """Reads tokens as terms and finds terms in sentences. Words are looked up once and remembered, up to a bound.

    learned: typical words of harmful samples with their class; they go into the trie beside the lexicon.
    """

    def __init__(self, vocabularies: dict[str, bytes] | None = None, learned: dict[str, str] | None = None) -> None:
        self.single: dict[str, tuple[str, float]] = {}
        self.phrases: dict[str, list[tuple[list[str], int, str, float]]] = {}
        for (kind, weight), text in LEXICON.items():
            if weight == 4.0:
                for phrase in text.split("|"):
                    words = phrase.replace("+", "").split()
                    anchor = next((k for k, w in enumerate(phrase.split()) if w[0] == "+"), 0)
                    self.phrases.setdefault(words[anchor], []).append((words, anchor, kind, weight))
            else:
                self.single |= {w: (kind, weight) for w in text.split()}
        self.typical = dict(learned or {})
        self.in_phrases = {w for held in self.phrases.values() for words, *_ in held for w in words}
        self.known = {*self.single, *self.phrases, *self.typical}
        self.undoubled: dict[str, set[str]] = {}
        for w in self.in_phrases:
            if len(w) >= 4:
                self.undoubled.setdefault(_DOUBLE.sub(r"\1", w), set()).add(w)
        self.trie = Trie(sorted(w for w in self.known | self.in_phrases if len(w) >= 3))
        # words that a public vocabulary holds whole are ordinary words, not misspellings
        self.ordinary = {fold(w) for w in whole_words(vocabularies or load())}
        self.vocabulary = frozenset(self.ordinary)
        self.ordinary -= self.known
        # rare words that are typical of hateful samples name groups: they are terms of their own
        self.single |= {w: (kind, 2.0) for w, kind in self.typical.items() if kind == "hateful" and w not in self.vocabulary and w not in self.single}
        self.memo: dict[str, tuple[str, frozenset[str]]] = {}

    def lookup(self, token: str) -> tuple[str, frozenset[str]]:
        """The term that a token stands for, or '', and the words it may be inside an idiom."""
        held = self.memo.get(token)
        if held is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            near: set[str] = set()
            c = self._canonical(token, near)
            held = self.memo[token] = c, frozenset({token} if token in self.in_phrases else near | {c or token})
        return held

    def canonical(self, token: str) -> str:
        return self.lookup(token)[0]

    def telling(self, token: str) -> bool:
        """Whether a token may be a term or the anchor of an idiom."""
        c, inside = self.lookup(token)
        return bool(c) or not inside.isdisjoint(self.phrases)

    def _canonical(self, token: str, inside: set[str]) -> str:
        if token in self.known:
            return token
        if token in self.ordinary:
            # vocabularies also hold parts of words (kil); inside an idiom a double letter may be missing or too many
            inside |= self.undoubled.get(_DOUBLE.sub(r"\1", token), set()) | {token}
            return ""
        letters = sum(c.isalpha() for c in token)
        if len(token) < 3:
            return ""
        if not token.isalpha():
            parts = re.split(r"[-_.·]", token)
            if "".join(parts) in self.known:
                return "".join(parts)
            if len(parts) > 1 and len(parts) < 0.5 * len(token) and all(p in self.ordinary or len(p) > 5 for p in parts):
                # a compound or an identifier: what its parts say, if strong
                return next((c for c in map(self.canonical, parts) if c and self.single.get(c, ("", 0))[1] >= 3), "")
            if "*" in token and (not token[0].isalpha() or letters < 2 and len(token) != 4) or letters < 0.4 * len(token) and "*" not in token:
                return ""
        size = sum(c not in _SEPARATORS for c in _STRETCH.sub(r"\1\1", token))
        hidden = "*" in token
        found = self.trie.near(token, 0 if hidden else 1 if size < 8 else 2)
        inside |= {w for _, w in found if w in self.in_phrases and len(w) >= 4}
        best = []
        for cost, w in found:
            if w in self.in_phrases and w not in self.single and w not in self.typical:
                continue
            if hidden:
                if len(w) == len(token):
                    best.append((cost, w))
            elif not cost:
                if len(w) >= 4 or not token.isalpha():
                    best.append((cost, w))
            elif cost == 1 and (len(w) > 4 or len(w) == 4 and (size > 4 or sorted(token) == sorted(w))) or cost == 2 and len(w) >= 9:
                # alone, a term of 4 letters with another letter or one less is too often another word (nuke)
                best.append((cost, w))
        return min(best, default=(0, ""))[1]

    def hits(self, tokens: list[str]) -> list[tuple[int, int, str, float]]:
        """(first, last token, class, weight) of the terms in a sentence."""
        found = []
        words = None
        for k, token in enumerate(tokens):
            c, inside = self.memo.get(token) or self.lookup(token)
            if c in self.single:
                found.append((k, k, *self.single[c]))
            for a in inside:
                for phrase, anchor, kind, weight in self.phrases.get(a, ()):
                    if words is None:
                        words = [self.lookup(t)[1] for t in tokens]
                    span = _around(words, k, phrase, anchor)
                    if span:
                        found.append((*span, kind, weight))
        return found


def _around(words: list[frozenset[str]], at: int, phrase: list[str], anchor: int) -> tuple[int, int] | None:
    """Where the phrase lies around its anchor, with at most one other word between its words."""
    low = high = at
    for w in reversed(phrase[:anchor]):
        low = next((p for p in (low - 1, low - 2) if p >= 0 and w in words[p]), -1)
        if low < 0:
            return None
    for w in phrase[anchor + 1 :]:
        high = next((p for p in (high + 1, high + 2) if p < len(words) and w in words[p]), -1)
        if high < 0:
            return None
    return low, high


def _plain(text: str) -> str:
    """Folded, with letters that were spaced out joined."""
    text = fold(text)
    return _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), text) if _SPACED.search(text) else text


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence of a whole text."""
    return [_TOKEN.findall(s) for s in _SENTENCE.split(_plain(text))]


def telling_sentences(matcher: Matcher, text: str) -> Iterator[list[str]]:
    """Those sentences of a whole text that hold a lexicon word: the others score 0."""
    plain = _plain(text)
    telling = [t for t in set(_TOKEN.findall(plain)) if matcher.telling(t)]
    if telling:
        for s in _SENTENCE.split(plain):
            if any(t in s for t in telling):
                yield _TOKEN.findall(s)


def context(tokens: list[str], first: int, last: int) -> set[str]:
    """What surrounds a hit: near words, who is spoken of, and whether it is quoted."""
    near = tokens[max(0, first - WINDOW) : first] + tokens[last + 1 : last + 1 + WINDOW]
    seen = {t for t in near if t not in _QUOTES and t not in "<>" and not re.search(r"[-_\d]", t)}
    if any(t in _QUOTES and t != "`" for t in tokens[max(0, first - 1) : first]) and any(t in _QUOTES for t in tokens[last + 1 : last + 2]):
        seen.add("⟦quoted⟧")
    if seen & {"you", "your", "you're", "yourself", "du", "dich", "dir", "dein", "tu", "te", "toi", "ton", "eres", "tus", "they", "they're", "their", "them", "him", "her", "who"}:
        seen.add("⟦someone⟧")
    return seen


@dataclass
class Model:
    """What the samples teach: words that are typical of harmful sentences with their class, context weights of hits, and odds of words and word pairs."""

    typical: dict[str, str] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    odds: dict[str, float] = field(default_factory=dict)


def _said(matcher: Matcher, tokens: list[str]) -> set[str]:
    """Words, read as terms where they stand for one, and word pairs of a sentence."""
    words = [matcher.canonical(t) or t for t in tokens if t not in _QUOTES and t not in "<>"]
    return {*words, *map(" ".join, zip(words, words[1:]))}


def _log_odds(bad: Counter, good: Counter, n_bad: int, n_good: int) -> dict[str, float]:
    return {w: math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((good[w] + 0.5) / (n_good + 1)) for w in {*bad, *good}}


def _clipped(odds: float) -> float:
    return max(-WORD_CLIP, min(WORD_CLIP, odds))


def fit_sentences(matcher: Matcher, samples: list[tuple[str, str]], rounds: int = 3) -> tuple[dict[str, str], dict[str, float]]:
    """(typical words with their class, odds of words and pairs), by naive Bayes over sentences.

    Which sentence of a harmful sample is the harmful one isn't labelled: at first all count, then the one with the
    highest odds, and the others count as harmless.
    """
    harmless = [f for text, label in samples if label == "none" for t in sentences(text) if (f := _said(matcher, t))]
    harmful = [([f for t in sentences(text) if (f := _said(matcher, t))], label) for text, label in samples if label != "none"]
    chosen = [(f, label) for held, label in harmful for f in held]
    others: list[set[str]] = []
    odds: dict[str, float] = {}
    bad, good = Counter(), Counter()
    for _ in range(rounds):
        bad, good = Counter(w for f, _ in chosen for w in f), Counter(w for f in (*harmless, *others) for w in f)
        odds = _log_odds(bad, good, len(chosen), len(harmless) + len(others))
        chosen, others = [], []
        for held, label in harmful:
            ranked = sorted(held, key=lambda f: (-sum(_clipped(odds[w]) for w in f), sorted(f)))
            chosen += [(f, label) for f in ranked[:1]]
            others += ranked[1:]
    # typical words: few that cover the harmful sentences twice, rare words first
    left = [(f, label, 2) for f, label in chosen]
    words = [w for w in bad if len(w) > 3 and w.isalpha() and bad[w] >= 3 and odds[w] >= 2.5]
    words.sort(key=lambda w: (w in matcher.vocabulary, -odds[w], w))
    typical: dict[str, str] = {}
    for w in words:
        kinds = Counter(label for f, label, k in left if k and w in f)
        if sum(kinds.values()) >= 3 or w not in matcher.vocabulary:
            kinds = kinds or Counter(label for f, label in chosen if w in f)
            typical[w] = min(kinds, key=lambda k: (-kinds[k], k))
            left = [(f, label, k - (w in f)) if k else (f, label, 0) for f, label, k in left]
    return typical, {w: _clipped(o) for w, o in odds.items() if bad[w] + good[w] >= 2}


def fit_context(matcher: Matcher, samples: list[tuple[str, str]]) -> dict[str, float]:
    """Naive Bayes log odds of each context word between hits in harmful and in harmless samples."""
    bad, good, n = Counter(), Counter(), [0, 0]
    for text, label in samples:
        for tokens in sentences(text):
            for first, last, _, weight in matcher.hits(tokens):
                if weight >= 4:
                    continue
                (good if label == "none" else bad).update(context(tokens, first, last))
                n[label != "none"] += 1
    learned = {}
    for w in {*bad, *good}:
        odds = math.log((bad[w] + 1) / (n[1] + 2)) - math.log((good[w] + 1) / (n[0] + 2))
        if bad[w] + good[w] >= 4:
            # words near a hit depend on each other, so each counts by half; quotation marks stand for themselves
            learned[w] = max(-CONTEXT_CLIP / 2, min(0.0, odds)) if w == "⟦quoted⟧" else _clipped(0.5 * odds)
    return learned


def fit(samples: list[tuple[str, str]], vocabularies: dict[str, bytes] | None = None) -> Model:
    """The model of labelled samples; without any it is empty, and the lexicon decides alone."""
    matcher = Matcher(vocabularies)
    typical, odds = fit_sentences(matcher, samples)
    return Model(typical, fit_context(matcher, samples), odds)


def score_sentence(matcher: Matcher, model: Model, tokens: list[str]) -> tuple[float, str]:
    """(score, class) of the strongest hit; several terms close together strengthen each other."""
    hits = matcher.hits(tokens)
    best = (0.0, "")
    for first, last, kind, weight in hits:
        near = context(tokens, first, last)
        others = sum(0.5 * w for f, l, _, w in hits if f > last or l < first)
        around = sum(model.context.get(c, 0.0) for c in near)
        if weight >= 4:
            around = min(0.0, 0.5 * around) if "⟦quoted⟧" not in near else -3.0
        value = weight + min(2.0, others) + max(-CONTEXT_CLIP, min(CONTEXT_CLIP, around)) - 1.0
        if value > best[0]:
            best = (value, kind)
    typical = next((c for c in map(matcher.canonical, tokens) if c in matcher.typical), None)
    if typical:
        evidence = sum(model.odds.get(w, 0.0) for w in _said(matcher, tokens))
        value = THRESHOLD * evidence / EVIDENCE
        if value > best[0]:
            best = (value, model.typical[typical])
    return best


def _scored(matcher: Matcher, model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            best, kind = 0.0, None
            for tokens in telling_sentences(matcher, text) if text else ():
                value, of = score_sentence(matcher, model, tokens)
                if value > best:
                    best, kind = value, of
            out.append((best, kind))
        yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("source"), pa.array([s for s, _ in out], pa.float64()), pa.array([k for _, k in out], pa.string())], ["document", "source", "score", "kind"])


def score_documents(documents: DataFrame, document: str, text: str, source: str, samples: DataFrame, sample_text: str, label: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(document, source, score, kind): each row's score over its whole text, 0 for null and empty texts.

    kind is the class of the strongest passage, null at score 0. Samples without text or label are left out; of more
    than SAMPLES the first by hash are taken. Rows stay as they are: repeated ids give repeated rows.
    """
    labelled = samples.select(F.col(sample_text).alias("text"), F.col(label).alias("label")).dropna()
    rows = [tuple(r) for r in labelled.orderBy(F.xxhash64("text"), "label").limit(SAMPLES).collect()]
    vocabularies = load(tokenizers)
    sent = documents.sparkSession.sparkContext.broadcast((vocabularies, fit(rows, vocabularies)))
    rows = documents.select(F.col(document).cast("long").alias("document"), F.col(source).alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model = sent.value
        yield from _scored(Matcher(held, model.typical), model, batches)

    return spread(rows).mapInArrow(run, "document long, source string, score double, kind string")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, cases, rate): per source in lower case without outer spaces; null sources are one group."""
    by = scores.groupBy(F.lower(F.trim("source")).alias("source"))
    counted = by.agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("cases"), F.avg("score").alias("mean_score"))
    return counted.withColumn("rate", F.col("cases") / F.col("documents"))
