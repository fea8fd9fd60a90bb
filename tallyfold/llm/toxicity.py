"""Toxicity by weak supervision: voters, a generative label model over their votes, and a linear classifier on its posterior.

Voters: the words of LEXICON; patterns (shouting, insults in the second person, symbols between letters); and entries that
the lexicon gains from the sample, words and beginnings of words, also of two words, that rows with label 1 share and rows with label 0 lack,
so often that chance would not make one such entry among all that were looked at. How strict that is, is
chosen by folds inside the training rows. A voter says 1 or abstains; a last one says 0 where no word voter
speaks. The label model has as parameters each voter's rate under either label, that is its accuracy, and the correlations of
the voters given the label; both are estimated by expectation maximisation on the votes alone. Where
several voters speak, each counts for the share of its evidence that their correlations leave it, so several entries for one
word do not count several times. A ridge
logistic regression on the voters that are properties of the text is trained on the posterior. Scoring reads whole texts
and nothing else of a row, by one automaton over all word voters.

Labels come only from rows whose crc32(doc_id) mod 5 is not 0. Training reads at most `most` such rows, those with the
smallest hash of doc_id (a bound on the sample of labelled rows; everything else covers all rows), and looks at the GAINED
most significant entries. Defined cases: null text is empty and scored; labels that are null or whose document is missing
are not used, of several for one document the greatest counts; without rows of both labels only the lexicon and patterns
vote; doc_id may be null (not held out) or repeated; an empty table gives an empty result; other columns are ignored by
toxicity() and kept by with_score().
"""

from __future__ import annotations

import collections
import functools
import math
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored

#: Common insults.
LEXICON = (
    "asshole bastard bitch clown coward creep crap cretin cunt damn degenerate dickhead disgusting dumb dumbass fool freak fuck garbage "
    "hate idiot ignorant imbecile jerk kill liar loser lunatic moron nazi pathetic pig psycho retard scum shit slut stupid sucker trash ugly "
    "vermin whore worthless abschaum arschloch dummkopf idiota imbécil salaud connard basura estúpido crétin ordure scheiße"
).split()
PATTERNS = {
    "shouting": re.compile(r"!{3,}"),
    "second_person": re.compile(r"\b(?:you|du|tu|vous)\b.{0,20}\b(?:idiot|loser|stupid|moron|scum|clown|pathetic|trash)\b", re.I | re.S),
    "masked": re.compile(r"\b\w+[*@#$]{2,}\w+\b"),
}
MOST, FOLDS, LENGTHS = 10_000, 5, (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"\w+")
#: Entries that the lexicon may gain, those looked at, and rows with label 1 that one must be in.
GAINED, LOOKED_AT, LEAST = 100, 2_000, 3
#: Chosen from by folds: how many entries as good as one that is taken chance may make.
CHANCE = (1.0, 0.01, 1e-5)


def stems(text: str) -> set[str]:
    """The words of a text; beginnings of longer ones, marked by a hyphen; and by two, beginnings that it has twice or more."""
    out, begun = set(), collections.Counter()
    for w, times in collections.Counter(WORD.findall(text.lower())).items():
        out.add(w)
        for n in LENGTHS:
            if len(w) > n:
                begun[w[:n]] += times
    out.update(b + "-" for b in begun)
    out.update(b + "--" for b, times in begun.items() if times > 1)
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """text, toxic and fold of at most `most` labelled rows outside the held-out fold. The labels are bounded before the join, so they can be sent to all tasks."""
    own = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["toxic"].cast("int").alias("toxic"))
    own = own.where(F.col("l_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("l_id")))
    own = own.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    fold = F.pmod(F.xxhash64("l_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    return id_and_text(docs).join(F.broadcast(own), F.col("doc_id") == F.col("l_id")).select("text", "toxic", fold)


def counted(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Entries that might be gained, their counts by (entry, fold, label), the rows by (fold, label), and how many different
    entries the sample has. Only the LOOKED_AT with most evidence reach the driver."""

    def count(batches):
        for b in batches:
            found: dict[str, np.ndarray] = {}
            for text, toxic, fold in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s in stems(text):
                    found.setdefault(s, np.zeros(2 * FOLDS, np.int64))[2 * fold + (toxic > 0)] += 1
            table = np.array(list(found.values()), np.int64).reshape(-1, 2 * FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array(table[:, i]) for i in range(2 * FOLDS))], ["stem", *cells])

    cells = [f"c{i}" for i in range(2 * FOLDS)]
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("one")).count().collect():
        sizes[r.fold, r.one] = r["count"]
    sums = rows.select("text", "toxic", "fold").mapInArrow(count, "stem string, " + ", ".join(f"{c} long" for c in cells)).groupBy("stem").agg(*[F.sum(c).alias(c) for c in cells])
    sums = stored(sums, "stems")
    clean, toxic = (functools.reduce(lambda x, y: x + y, [F.col(c) for c in cells[i::2]]) for i in (0, 1))
    share = max(int(sizes[:, 1].sum()), 1) / max(int(sizes.sum()), 1)
    # log-likelihood against the share of toxic rows, enough to rank by
    p = toxic / (toxic + clean)
    evidence = toxic * F.log(p / share) + F.when(clean > 0, clean * F.log((1 - p) / (1 - min(share, 0.999)))).otherwise(0.0)
    best = sums.where((toxic >= LEAST) & (p > share)).orderBy(F.desc(evidence), F.length("stem"), "stem").limit(LOOKED_AT).collect()
    table = np.array([[r[c] for c in cells] for r in best], np.int64).reshape(-1, FOLDS, 2)
    return [r.stem for r in best], table, sizes, sums.count()


def surprise(toxic: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """Log of a bound on the chance that so many of the rows that an entry is in have label 1 (Chernoff)."""
    p = np.clip(toxic / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    bound = -seen * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return np.where((p > share) & (toxic >= LEAST), bound, 0.0)


def gained(names: list[str], table: np.ndarray, sizes: np.ndarray, different: int, chance: float) -> tuple[list[int], np.ndarray]:
    """The entries that chance would not make, of those that begin alike only the most surprising, and their purity."""
    toxic, seen, total = table[:, :, 1].sum(1), table.sum((1, 2)), sizes.sum(0)
    if not len(names) or not total.min():
        return [], np.zeros(0)
    bound = surprise(toxic, seen, total[1] / total.sum())
    out: list[int] = []
    for i in np.lexsort((np.array([len(n) for n in names]), bound)):
        if bound[i] > math.log(chance / different) or len(out) == GAINED:
            break
        own = names[i].rstrip("-")
        if not any(own.startswith(o) or o.startswith(own) for o in (names[j].rstrip("-") for j in out)):
            out.append(int(i))
    return out, (toxic[out] + 1) / (seen[out] + 2)


def automaton(voters: tuple[str, ...]):
    """Finds all word voters in one pass over a text."""
    a = ahocorasick.Automaton()
    for i, v in enumerate(voters):
        start = v.rstrip("-")
        a.add_word(start, (*(a.get(start, ())), (i, len(start), len(v) - len(start))))
    if voters:
        a.make_automaton()
    return a


_built: dict = {}


def votes(texts, voters: list[str]) -> np.ndarray:
    """One column for each voter and pattern: 1 or 0; a beginning votes for one longer word that begins so, or for two."""
    key = tuple(voters)
    if key not in _built:
        _built.clear()
        _built[key] = automaton(key)
    found = _built[key]
    inside = lambda c: c.isalnum() or c == "_"
    out = np.zeros((len(texts), len(voters) + len(PATTERNS)), np.int8)
    twice = np.array([v.endswith("--") for v in voters], bool)
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for last, entries in found.iter(low) if voters else ():
            on = last + 1 < len(low) and inside(low[last + 1])
            for i, n, hyphens in entries:
                if on == (hyphens > 0) and (last < n or not inside(low[last - n])):
                    out[row, i] = min(2, out[row, i] + 1)
        out[row, : len(voters)] = out[row, : len(voters)] > twice
        for i, p in enumerate(PATTERNS.values()):
            out[row, len(voters) + i] = p.search(text or "") is not None
    return out


def label_model(v: np.ndarray, trusted: int, purity: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The posterior of label 1 for each row of votes. The first `trusted` columns are word voters; to them comes the voter
    for 0, which speaks where they are silent. Abstaining says nothing. purity: where the word voters' accuracy starts from."""
    silent = v[:, :trusted].sum(1) == 0
    v = np.c_[v, silent].astype(float)
    n = len(v)
    post = np.where(silent, 0.02, 1 - np.exp(v[:, :trusted] @ np.log1p(-purity)))
    prior = np.clip(post.mean(), 0.01, 0.9)
    # where the rates start from counts twice as much as the rows: voters that meet no others do not turn round
    rates = lambda p: ((p @ v + 0.5 * prior) / (p.sum() + 1), ((1 - p) @ v + 0.5 * (1 - prior)) / (n - p.sum() + 1))
    start = rates(post)
    for i in range(rounds):
        one, zero = ((r + 2 * s) / 3 for r, s in zip(rates(post), start))
        # correlations of the votes given the label; where several speak, each keeps what the others do not bring as well
        if not i % 5:
            rest = v - np.outer(post, one) - np.outer(1 - post, zero)
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            rho = rest.T @ rest / n / np.outer(sd, sd)
            np.fill_diagonal(rho, 0)
            share = 1 / (1 + v @ np.maximum(rho, 0) ** 2)
        score = math.log(prior / (1 - prior)) + (v * share) @ np.log(one / zero)
        before, post = post, 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(post - before).max() < 1e-4:
            break
    return post


def features(v: np.ndarray, trusted: int) -> np.ndarray:
    """Votes, and whether one or two word voters speak: rare voters are pooled in these."""
    n = v[:, :trusted].sum(1, dtype=np.int64)
    return np.c_[v, n >= 1, n >= 2].astype(float)


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))].astype(float)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - target) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(v: np.ndarray, trusted: int, purity: np.ndarray) -> np.ndarray:
    return linear(features(v, trusted), label_model(v, trusted, purity))


def chance_of(v: np.ndarray, trusted: int, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(v, trusted) @ weights[:-1] + weights[-1], -30, 30)))


def model(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """Voters and weights: their number has a bound, whatever the size of the corpus."""
    rows = stored(sample(docs, labels, most), "labelled")
    names, table, sizes, different = counted(rows)
    every = [*LEXICON, *(n for n in names if n not in LEXICON)]
    place = {n: i for i, n in enumerate(every)}

    def cast(batches):
        for b in batches:
            v = votes(b.column(0).to_pylist(), every)
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(r).tobytes() for r in v], pa.binary()), b.column(1), b.column(2)], ["v", "toxic", "fold"])

    got = rows.select("text", "toxic", "fold").mapInArrow(cast, "v binary, toxic int, fold int").collect()
    if not got:  # two word voters, or one and a pattern, are taken as toxic
        return LEXICON, np.r_[np.zeros(len(LEXICON)), np.ones(len(PATTERNS)), 2.5, 1.0, -3.0]
    got.sort()
    v = np.unpackbits(np.frombuffer(b"".join(r.v for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(every) + len(PATTERNS)]
    label, fold = (np.array([r[i] for r in got]) for i in (1, 2))
    patterns = list(range(len(every), len(every) + len(PATTERNS)))

    def chosen(folds: list[int], chance: float):
        taken, purity = gained(names, table[:, folds], sizes[folds], different, chance)
        new = [(place[names[i]], p) for i, p in zip(taken, purity) if names[i] not in LEXICON]
        return [*range(len(LEXICON)), *(i for i, _ in new)], np.array([*[0.9] * len(LEXICON), *(p for _, p in new)])

    def loss(chance: float) -> float:
        """Of folds that neither the voters nor the model have seen."""
        total = 0.0
        for f in range(FOLDS):
            kept, own = fold != f, fold == f
            if not own.any() or not kept.any():
                continue
            word, purity = chosen([k for k in range(FOLDS) if k != f], chance)
            columns = word + patterns
            p = np.clip(chance_of(v[own][:, columns], len(word), fitted(v[kept][:, columns], len(word), purity)), 1e-4, 1 - 1e-4)
            total -= np.log(np.where(label[own] > 0, p, 1 - p)).sum()
        return total

    word, purity = chosen(list(range(FOLDS)), min(CHANCE, key=loss))
    return [every[i] for i in word], fitted(v[:, word + patterns], len(word), purity)


def scorer(voters: list[str], weights: np.ndarray):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            part = texts.iloc[at : at + 512].tolist()
            out[at : at + 512] = chance_of(votes(part, voters), len(voters), weights)
        return pd.Series(out)

    return score


def with_score(docs: DataFrame, labels: DataFrame, most: int = MOST, out_col: str = "toxicity", text_col: str = "text") -> DataFrame:
    """docs with the chance of label 1, which takes the place of a column of that name."""
    return docs.withColumn(out_col, scorer(*model(docs, labels, most))(docs[text_col].cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is 0.5 or more)."""
    d = id_and_text(docs)
    scored = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(*model(docs, labels, most))(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
