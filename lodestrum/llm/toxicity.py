"""Toxicity by weak supervision.

Many voters look at a text: one for each word of a lexicon, which is a seed list and words mined from the training rows;
some for how the lexicon's words stand in the text; and some for patterns that know nothing of the lexicon, as shouting,
frames of insults, masked letters or beginnings of words that toxic training texts share in many forms. A generative label model takes their votes as noisy readings of a hidden label. It estimates each
voter's accuracy and abstention by expectation maximisation, and the correlations that remain between voters given the
label, which lower the weight of voters that say the same. What the training row is marked is one more reading, of a fixed
trust, so the hidden label means what the labels mark, whatever the voters suppose. Its posterior labels train a linear classifier on words and
votes; the classifier alone scores the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrum.llm.common import bounded_batches, decoded, taught, texts

#: Common insults that seed the lexicon.
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk filth garbage imbecile cretin vermin".split()
WORD = re.compile(r"[^\W\d_]+")
#: Patterns of voters that don't know the lexicon.
PATTERNS = {
    "shouting": regex.compile(r"\b\p{Lu}{2,}(?:[^\w\n]+\p{Lu}{2,}){2}\b"),
    "exclaiming": re.compile(r"[!?]{2}"),
    "framed": re.compile(r"(?i)\b(?:you(?: are|'re)|you) (?:a |an |such |so |all )+\w+|\bshut up\b|\b(?:i|we) (?:hate|despise) you\b|\bgo to hell\b|\bwhat an? \w+!"),
    "masked": re.compile(r"[*@#$](?<=[^\W\d_].)[*@#$]*[^\W\d_]"),
    "drawn_out": re.compile(r"([^\W\d_])\1{3}"),
}
YOU = re.compile(r"(?i)\b(you|your|you're|du|tu|eres)\b")
#: The bound of the training sample: labelled rows, whole ones.
SAMPLE_ROWS = 4000
FOLDS, HELD = 5, 0
#: A mined word occurs in so many toxic texts, so much oftener than in others, in so varied surroundings.
MINED_TEXTS, MINED_LIFT, MINED_VARIETY = 8, 10.0, 0.6
#: Lengths of beginnings of words, and forms in which a mined one occurs.
STEMS, MINED_FORMS = (4, 5, 6, 7), 4
KEPT_WORDS = 300_000
VOCABULARY = 20_000
TOXIC, CLEAN, ABSTAIN = 0, 1, 2
#: Voters whose votes correlate more than this count as one.
ALIKE = 0.9
#: A correlation given the label up to this much is left to chance and to the fit's own error.
CHANCE = 0.2
#: The log-odds that a training row's own label gives: it is right in about 19 of 20 cases.
TRUST = 3.0


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mine(sample: list[tuple[list[str], int]]) -> list[str]:
    """Words that mark toxic training texts. Surroundings must vary: words that only copies of one text share mark nothing."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    around: dict[str, set[str]] = defaultdict(set)
    for words, y in sample:
        seen[y].update(set(words))
        if y:
            for before, w in zip(["", *words], words, strict=False):
                around[w].add(before)
    n = [1 + sum(1 for _, y in sample if y == k) for k in (0, 1)]
    lift = lambda w: (seen[1][w] / n[1]) / ((seen[0][w] + 0.5) / n[0])
    return sorted(w for w, k in seen[1].items() if k >= MINED_TEXTS and lift(w) >= MINED_LIFT and len(around[w]) >= MINED_VARIETY * k)


def beginnings(words: list[str]) -> set[str]:
    """What words begin with, in STEMS lengths and with something after it."""
    return {w[:n] for w in set(words) for n in STEMS if len(w) > n}


def mine_stems(sample: list[tuple[list[str], int]]) -> list[str]:
    """Beginnings of words that mark toxic training texts in various forms: an insult has endings. Of beginnings that contain
    each other the shortest counts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    forms: dict[str, set[str]] = defaultdict(set)
    for words, y in sample:
        seen[y].update(beginnings(words))
        if y:
            for w in set(words):
                for n in STEMS:
                    if len(w) > n:
                        forms[w[:n]].add(w)
    n = [1 + sum(1 for _, y in sample if y == k) for k in (0, 1)]
    lift = lambda w: (seen[1][w] / n[1]) / ((seen[0][w] + 0.5) / n[0])
    good = [w for w, k in seen[1].items() if k >= MINED_TEXTS and lift(w) >= MINED_LIFT and len(forms[w]) >= MINED_FORMS]
    out: list[str] = []
    for w in sorted(good, key=lambda w: (len(w), w)):
        if not any(w.startswith(x) for x in out):
            out.append(w)
    return sorted(out)


class Voters:
    def __init__(self, lexicon: list[str], stems: list[str] = []) -> None:  # noqa: B006  never changed
        self.lexicon, self.stems = lexicon, stems
        self.stem_place = {w: i for i, w in enumerate(stems)}
        self.kept: dict[str, tuple[int, ...]] = {}  # voters of words met before: most have none
        self.place = {w: i for i, w in enumerate(lexicon)}
        self.seeds = frozenset(SEEDS)
        self.names = [*(f"word:{w}" for w in lexicon), "several", "dense", "addressed", "lone", "none", *PATTERNS, "composed", *(f"stem:{w}" for w in stems), "stems"]

    def votes(self, text: str, words: list[str]) -> np.ndarray:
        out = np.full(len(self.names), ABSTAIN, np.int8)
        several, dense, addressed, lone, none, pattern = range(len(self.lexicon), len(self.lexicon) + 6)
        stem = pattern + len(PATTERNS) + 1
        counts, hits, begun, kept = Counter(words), [], set(), self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in counts:
            if (told := kept.get(w)) is None:
                told = [stem + k for size in STEMS if len(w) > size and (k := self.stem_place.get(w[:size])) is not None]
                told = kept[w] = (*((self.place[w],) if w in self.place else ()), *told)
            for k in told:
                out[k] = TOXIC
                if k < stem:
                    hits.append(w)
                else:
                    begun.add(k)
        if len(begun) >= 2:
            out[-1] = TOXIC
        times = sum(counts[w] for w in hits)
        if len(hits) >= 2:
            out[several] = TOXIC
        if hits and times * 200 >= len(words):
            out[dense] = TOXIC
        if (len(hits) >= 2 or not self.seeds.isdisjoint(hits)) and YOU.search(text):
            out[addressed] = TOXIC
        if times == 1 and hits[0] not in self.seeds:  # one mined word may be there by chance: how often, the model learns
            out[lone] = CLEAN
        if not hits and not begun:
            out[none] = CLEAN
        seen = [p.search(text) is not None for p in PATTERNS.values()]
        out[pattern : pattern + len(seen)][seen] = TOXIC
        if not any(seen):
            out[pattern + len(seen)] = CLEAN
        return out


class LabelModel:
    """Class-conditional vote tables, class balance, and weights that correlations lower."""

    def fit(self, votes: np.ndarray, prior: float, rounds: int = 25, labels: np.ndarray | None = None) -> LabelModel:
        """Accuracies and correlations are learned from how the votes agree, with each other and with the rows' labels where
        those are given. Without labels, voters are taken to be right oftener than not."""
        n, m = votes.shape
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        one = np.stack([votes == v for v in (TOXIC, CLEAN, ABSTAIN)], 2).astype(float)  # text, voter, vote
        signed = (votes == TOXIC).astype(float) - (votes == CLEAN)
        # Voters that vote alike nearly always are one voter, or they would pass for the hidden label itself.
        centred = signed - signed.mean(0)
        size = np.sqrt((centred**2).mean(0)) + 1e-9
        alike = ((centred / size).T @ (centred / size) / max(n, 1) > ALIKE) | np.eye(m, dtype=bool)
        own = 1 / alike.sum(1)
        self.weights = own.copy()
        toxic = np.clip(0.5 + 0.45 * np.sign(signed @ own), 0.02, 0.98) if labels is None else np.where(labels == 1, 0.95, 0.05)
        for _ in range(rounds):
            mass = np.stack([toxic, 1 - toxic], 1)
            # A voter is taken to be right oftener than not: the prior counts say so. Labels tell it better.
            lean = np.array([[2.0, 0.2, 1.0], [0.2, 2.0, 1.0]] if labels is None else [[1.0] * 3] * 2)[:, None, :].repeat(m, 1)
            table = np.einsum("nk,nmv->kmv", mass, one) + lean
            self.table = table / table.sum(2, keepdims=True)
            # Correlations given the label: of what a vote has beyond its expectation.
            values = np.array([1.0, -1.0, 0.0])
            rest = signed - mass @ (self.table @ values)
            scale = np.sqrt((rest**2).mean(0)) + 1e-6
            self.correlation = (rest / scale).T @ (rest / scale) / max(n, 1)
            np.fill_diagonal(self.correlation, 0)
            self.weights = own / (1 + np.where(alike, 0, np.clip(self.correlation - CHANCE, 0, None)).sum(1))
            toxic = self.posterior(votes, labels)
        self.accuracy = self.table[0, :, TOXIC] / (self.table[0, :, TOXIC] + self.table[1, :, TOXIC])
        return self

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        logs = np.log(self.table[0] / self.table[1])
        logs[:, ABSTAIN] = 0  # who doesn't vote says nothing: a text in one language lacks all insults of the others
        z = np.log(self.prior / (1 - self.prior)) + sum(self.weights[j] * logs[j, votes[:, j]] for j in range(votes.shape[1]))
        z = z if labels is None else z + TRUST * (2 * labels - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class ToxicityModel:
    """The linear classifier: a weight for each known word's presence and each vote, and a constant."""

    def __init__(self, sample: list[tuple[str, int]], prior: float = 0.5, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> None:
        read = [(words_of(t), y) for t, y in sample]
        lexicon = sorted({*SEEDS, *mine(read)})
        self.voters = Voters(lexicon, mine_stems(read))
        self.label_model: LabelModel | None = None
        common = Counter(w for words, _ in read for w in set(words))
        kept = [w for w, n in sorted(common.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
        self.lexical = {w: i for i, w in enumerate(sorted({*kept, *self.voters.lexicon}))}
        self.w, self.v, self.c = np.zeros(len(self.lexical)), np.zeros(len(self.voters.names)), 0.0
        if not sample:
            return
        votes = np.stack([self.voters.votes(t, words) for (t, _), (words, _) in zip(sample, read, strict=True)])
        labels = np.array([y for _, y in sample])
        self.label_model = LabelModel().fit(votes, prior, labels=labels)
        soft = self.label_model.posterior(votes, labels)
        fired = (votes == TOXIC).astype(float) - (votes == CLEAN)
        ids = [np.array([self.lexical[w] for w in set(words) if w in self.lexical], int) for words, _ in read]
        rng, sw, sv, sc = np.random.default_rng(seed), np.full(len(self.w), 1e-3), np.full(len(self.v), 1e-3), 1e-3
        for _ in range(epochs):
            for i in rng.permutation(len(ids)):
                # Words share one unit of evidence, however many a text has.
                share = 1 / np.sqrt(len(ids[i]) + 1)
                z = self.c + share * self.w[ids[i]].sum() + self.v @ fired[i]
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[i]
                gw, gv = g * share + decay * self.w[ids[i]], g * fired[i] + decay * self.v
                sw[ids[i]] += gw**2
                sv += gv**2
                sc += g * g
                self.w[ids[i]] -= rate * gw / np.sqrt(sw[ids[i]])
                self.v -= rate * gv / np.sqrt(sv)
                self.c -= rate * g / np.sqrt(sc)

    def score(self, text: str) -> float:
        words = words_of(text)
        known = [i for w in set(words) if (i := self.lexical.get(w)) is not None]
        votes = self.voters.votes(text, words)
        fired = (votes == TOXIC).astype(float) - (votes == CLEAN)
        z = self.c + self.w[known].sum() / np.sqrt(len(known) + 1) + self.v @ fired
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row's whole text.

    The fit reads at most `rows` labelled texts outside the held-out fold, each whole; documents whose labels contradict each other teach nothing. Texts of any length are scored whole, a null one
    as an empty one. A null id is never held out; repeated rows get the same score. An empty table gives no rows; without
    labels every score is one half. Further columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = texts(df, id_col, text_col)
    model = spark.sparkContext.broadcast(taught(docs, labels, "toxic", FOLDS, HELD, rows, ToxicityModel))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.value.score(t) for t in decoded(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return docs.withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
