"""Toxicity scores from a learned lexicon, matched with Levenshtein automata, and the context of each match.

1. From a bounded sample of labelled texts: words whose documents are mostly toxic become terms, and beginnings shared by
   several such words become stems. Both form a trie.
2. A token is matched by walking the trie side by side with the token's Levenshtein automaton, which finds terms within
   one edit (two for long tokens) without trying them one by one. A stem matches by the exact beginning of a token.
3. Each match is judged by its window: inside a quotation of bounded length or next to words of reporting it counts as
   quoted, next to words of address as aimed at someone.
4. A logistic regression over the counts of plain, stem, misspelled, quoted and aimed matches gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.llm.common import materialize

#: Labelled rows used for learning, and what a term needs. Every term needs several of these rows, so they bound the lexicon too.
TRAIN_ROWS = 20_000
LEAST_LENGTH, LEAST_DOCS, LEAST_PRECISION = 3, 4, 0.6
#: A stem: length, different words and documents needed, and the precision of all words that begin with it.
STEM_LENGTHS, STEM_WORDS, STEM_DOCS, STEM_PRECISION = (4, 5, 6, 7), 5, 20, 0.9
#: Token lengths from which one and two edits are allowed.
ONE_EDIT, TWO_EDITS = 5, 9
#: Tokens around a match that are its context, and tokens that a quotation may have.
CONTEXT, QUOTED = 6, 60
#: Tokens a matcher remembers, and their longest length; longer ones are matched each time.
REMEMBERED, REMEMBERED_LENGTH, MOST_STATES = 500_000, 64, 50_000

#: Words of reporting and of address in the four languages of the corpus.
REPORTING = frozenset("said says wrote quote quoted called word term sagte schrieb zitat wort nannte dit écrit citation mot appelé "
                      "dijo escribió cita palabra llamó".split())
ADDRESS = frozenset("you your you're du dich dir dein ihr euch tu toi vous votre ton tú te ti usted tus vosotros".split())
#: Quotation marks, each with the marks that close what it opens.
CLOSERS = {'"': '"', "«": "»", "»": "«", "“": "”", "”": "”", "„": "“”", "‹": "›", "›": "‹"}

TOKEN = re.compile(r"[^\W_]+|[\"«»“”„‹›]")
TOKEN_OR_LINE = re.compile(TOKEN.pattern + r"|[\n\r]")
#: ``plain`` counts all matches that are not quoted, so a kind too rare to have a weight of its own weighs like the others.
FEATURES = ("plain", "stem", "misspelled", "quoted", "aimed", "any", "share")


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


class LexiconAutomaton:
    """The trie of the terms intersected with Levenshtein automata: accepts what lies within ``edits`` of some term.

    A state maps trie nodes to the fewest edits with which they are reached. States and their transitions are made when
    a token first needs them and then shared by all tokens, so a token costs a table lookup per character, up to the
    character after which no term is left.
    """

    def __init__(self, terms: tuple[str, ...], edits: int) -> None:
        self.edits, self.alphabet = edits, frozenset("".join(terms))
        self.children: list[dict[str, int]] = [{}]
        ends = set()
        for term in terms:
            node = 0
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                node = self.children[node][char]
            ends.add(node)
        self.ends = ends
        self._clear()

    def _clear(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.accepting: list[bool] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of a state, completed by the terms' characters that the token may lack; -1 without a node."""
        todo = list(nodes)
        for node in todo:
            spent = nodes[node] + 1
            if spent <= self.edits:
                for child in self.children[node].values():
                    if spent < nodes.get(child, self.edits + 1):
                        nodes[child] = spent
                        todo.append(child)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(nodes)
            self.accepting.append(not self.ends.isdisjoint(nodes))
            self.steps.append({})
        return self.known[key]

    def _step(self, state: int, char: str) -> int:
        after: dict[int, int] = {}
        most = self.edits + 1
        for node, spent in self.states[state].items():
            if spent < self.edits and spent + 1 < after.get(node, most):
                after[node] = spent + 1  # a character too many
            for own, child in self.children[node].items():
                cost = spent + (own != char)
                if cost <= self.edits and cost < after.get(child, most):
                    after[child] = cost
        self.steps[state][char] = found = self._state(after)
        return found

    def accepts(self, token: str) -> bool:
        if len(self.states) > MOST_STATES:
            self._clear()
        state = self.start
        for char in token:
            if char not in self.alphabet:
                char = ""
            after = self.steps[state].get(char)
            state = self._step(state, char) if after is None else after
            if state < 0:
                return False
        return self.accepting[state]


class Matcher(dict):
    """Kind of match of each token, remembered up to a bound; None for no match."""

    def __init__(self, terms: tuple[str, ...], stems: tuple[str, ...]) -> None:
        super().__init__()
        self.terms, self.stems = frozenset(terms), stems
        self.automata = [LexiconAutomaton(terms, edits) for edits in (1, 2)]

    def misspelled(self, token: str) -> bool:
        """Whether some term lies within the edits that the token's length allows."""
        edits = (len(token) >= ONE_EDIT) + (len(token) >= TWO_EDITS)
        return 0 < edits and self.automata[edits - 1].accepts(token)

    def __missing__(self, token: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        kind = "exact" if token in self.terms else "stem" if token.startswith(self.stems) else "misspelled" if self.misspelled(token) else None
        if len(token) <= REMEMBERED_LENGTH:
            self[token] = kind
        return kind


@lru_cache(maxsize=2)
def matcher_of(terms: tuple[str, ...], stems: tuple[str, ...]) -> Matcher:
    """One matcher for all tasks that a worker process runs with the same lexicon."""
    return Matcher(terms, stems)


def tokens_of(text: str | None) -> list[str]:
    """Words and quotation marks, the tokens of learning and of matching."""
    return TOKEN.findall(text.lower()) if text else []


def quoted_tokens(text: str) -> set[int]:
    """Numbers of the tokens inside quotations.

    A quotation ends at its closing mark, on the same line and after at most ``QUOTED`` tokens. A mark without such an
    end opens nothing, so an inch sign or a lost mark does not change how the rest of a text is read.
    """
    marks, n = [], 0  # marks as (number of the token, mark), with a line end as the mark ""
    for t in TOKEN_OR_LINE.findall(text.lower()):
        if t in "\r\n":
            marks.append((n, ""))
        else:
            if t in CLOSERS:
                marks.append((n, t))
            n += 1
    inside, k = set(), 0
    while k < len(marks):
        start, mark = marks[k]
        k += 1
        if not mark:
            continue
        for j in range(k, len(marks)):
            end, closing = marks[j]
            if not closing or end - start > QUOTED + 1:
                break
            if closing in CLOSERS[mark]:
                inside.update(range(start + 1, end))
                k = j + 1
                break
    return inside


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Counts of matches by kind and context over the whole text, damped by logarithms; zeros without a match."""
    tokens = tokens_of(text)
    hits = [i for i, t in enumerate(tokens) if matcher[t]]
    if not hits:
        return [0.0] * len(FEATURES)
    inside = quoted_tokens(text)
    count = dict.fromkeys((*FEATURES, "exact"), 0)
    for i in hits:
        window = tokens[max(0, i - CONTEXT):i] + tokens[i + 1:i + 1 + CONTEXT]
        if i in inside or not REPORTING.isdisjoint(window):
            count["quoted"] += 1
        else:
            count["plain"] += 1
            count[matcher[tokens[i]]] += 1
            count["aimed"] += not ADDRESS.isdisjoint(window)
    return [*(float(np.log1p(count[k])) for k in FEATURES[:5]), float(count["plain"] > 0), min(1.0, 20.0 * count["plain"] / len(tokens))]


def train_words(train: DataFrame) -> DataFrame:
    """``(word, toxic)``: the different words of each training text, cut as they are for matching."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                words = sorted({t for t in tokens_of(text.as_py()) if len(t) >= LEAST_LENGTH})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic.as_py()] * len(words), pa.int32())], ["word", "toxic"])

    return train.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic int")


def learn_lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems of ``train (text, toxic)``: all whose precision, lowered by its spread, is high enough."""
    words = train_words(train).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    words = materialize(words, "toxicity-words")
    precision = (F.col("bad") - F.sqrt(F.col("bad") * (F.col("n") - F.col("bad")) / F.col("n"))) / (F.col("n") + 1.0)
    stems = words.select(F.explode(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("stem"), "n", "bad").where(
        "stem IS NOT NULL").groupBy("stem").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(
        f"words >= {STEM_WORDS} AND n >= {STEM_DOCS} AND bad >= {STEM_PRECISION} * n")
    found = {r.stem for r in stems.select("stem").collect()}
    # a stem that begins with another one adds nothing
    kept = [s for s in found if not any(s[:k] in found for k in range(1, len(s)))]
    terms = words.where((F.col("n") >= LEAST_DOCS) & (precision >= LEAST_PRECISION)).select("word")
    return sorted(r.word for r in terms.collect()), sorted(kept)


def with_features(rows: DataFrame, terms: list[str], stems: list[str]) -> DataFrame:
    """``rows (text, ...)`` without the text, with an array ``features``. The lexicon, of bounded size, goes along."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(tuple(terms), tuple(stems))
        for batch in batches:
            found = [features(x.as_py(), matcher) for x in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others],
                                              pa.array(found, pa.list_(pa.float64()))], [*others, "features"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", features array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the last one constant; Newton's method with a ridge."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``(text, toxic)`` of labelled rows outside the held-out fifth: about ``most`` of them, chosen by a hash of doc_id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(8), "doc_id"), 11) / F.lit(float(1 << 53))
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(known.where(unit * n < most), "doc_id").select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Nothing but the text enters a score. NULL and empty texts score like texts without a match; without labels of both
    kinds every score is 0. A NULL doc_id is scored and not held out; repeated rows stay.
    """
    train = materialize(training_rows(docs, labels, most), "toxicity-train")
    terms, stems = learn_lexicon(train)
    known = with_features(train, terms, stems).select("features", "toxic").toPandas()
    y = (known["toxic"].to_numpy() > 0).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        weights = fit(np.stack(known["features"]), y).tolist()
    else:
        weights = [0.0] * len(FEATURES) + [-1e9]
    margin = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        margin = margin + F.lit(w) * F.col("features")[i]
    scored = with_features(docs.select("doc_id", "text"), terms, stems).select(
        "doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
