"""Problem 8: per-document text quality statistics, and what they say about a document's shape.

Method: statistics per document, on an open scale (shares as log odds, rare things as logarithms), standardised with the
means and deviations of the whole corpus, and a mixture of Gaussians (diagonal) fitted to them by
expectation-maximisation. Every pass of the fit reads all documents: each task sums the responsibilities of its rows,
Spark adds them up, and only COMPONENTS x (2 x statistics + 1) numbers reach the driver. The fit ends when a pass gains
less than GAIN of mean log likelihood. Components are mapped to prose, list, table or junk by inspected examples
(EXAMPLES below): each example votes with its posterior. A document's shape is that of the largest summed posterior of
the components mapped to it; nothing else decides, and equal posteriors go to the first of SHAPES.

The examples also stand in the fit as a weak prior (PRIOR rows each), so that a small corpus without junk, say, still has
a component for it.

Defined results: null, empty and blank texts get statistics of zero and no shape; repeated texts get equal rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, checkpointed, map_rows, normal, spread, table

SHAPES = ("prose", "list", "table", "junk")
COMPONENTS = 12
#: A pass that raises the mean log likelihood by less ends the fit; a fit that needs more passes than PASSES is an error.
GAIN = 1e-3
PASSES = 200
#: Rows that each component's example counts for, and the least variance of a component.
PRIOR = 0.5
FLOOR = 0.05

_WORDS = re.compile(r"\w+")
_UNSPACED = re.compile(r"[ก-๎぀-ヿ㐀-鿿]")
_STOPS, _AFTER_STOP = frozenset(".!?。！？…؟:：;；"), " \t\r\v\f\xa0\u3000\u2009\u202f\"'”’»›」』）)]“*_"
_MARKED = re.compile(r"\s*(?:[-–—•·・*+▪◦‣○●■□–]|\[[ xX]?\]|[☐☑✓]|\(?\d{1,4}[.)、]|\(?[A-Za-z]\)|[a-z]\.)\s+\S|\s*[・•]\S")
_LEADER = re.compile(r"(?<!^)(?:(?<!\.)\.{3,}|(?<!…)…{2,}|(?<!·)·{3,}|(?<!_)_{3,}|(?<!\. )(?:\. ){3,})\s*(?:\d+|[ivxlc]+)\s*$")
_LEADERS = ("...", "……", "···", "___", ". . ")
_INDEX = re.compile(r"\s*[^,|\t]{1,60}?,(?:\s+\d+(?:[–-]\d+)?,?)+\s*$")
_GLOSS = re.compile(r"\s*[^\s:：=|]+(?:\s[^\s:：=|]+){0,3}\s*(?::|：|=|\s[—–-])\s+\S")
_SENTENCE = re.compile(r"[。！？]|[.!?…][\"”»)]*\s")
_COMMA = re.compile(r",(?!\s)")
_RULED = re.compile(r"\s*\|?[\s:|+-]*-{2,}[\s:|+-]*$")
_ALIGNED = re.compile(r"(?<=[^\s.!?。！？…”»」』)]) {2,}(?=\S)|^ {3,}(?=\S)")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{28,}")
_HEX = re.compile(r"\b(?:[0-9a-fA-F]{2})+\b")
_SOUP = re.compile(r"(?<![\w'’])[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{3,}(?![\w'’.])")
_L = "A-Za-zÀ-ɏЀ-ӿ"
_BROKEN = re.compile(
    rf"�|[\x80-\x9f]|[ÃÂÄÅâåäæçèéêëìíïðñãàáØÙÐÑ][\xa0-\xbf]|(?<=\w)\?(?=\w)|[~^°¬¦_|»\\<>={{}}@#$%&*+](?=[{_L}])"
    rf"|(?<=[{_L}])[~^°¬¦_|«\\<>={{}}@#$%&*+;:)(,!\"]+(?=[{_L}])"
)
STATISTICS = ["words", "word_length", "symbols", "line_ends", "common", "entries", "fields", "damage", "repeated", "line_length"]


def ended(line: str) -> bool:
    """Whether a line ends in punctuation, quotes and brackets aside."""
    return line.rstrip(_AFTER_STOP)[-1:] in _STOPS


def entry(line: str, first: bool = False) -> bool:
    """Whether a line is an entry of a list, glossary, index or contents page. A first line without a mark is a title."""
    if _MARKED.match(line) or _INDEX.match(line) or line.rstrip()[-1:].isalnum() and any(x in line for x in _LEADERS) and _LEADER.search(line):
        return True
    if first or ended(line):
        return False
    if _GLOSS.match(line):
        return True
    s = line.strip()
    if s[0] in "“„«‹「『\"(（" or not any(c.isalpha() for c in s) or "|" in s or "\t" in s or ";" in s:
        return False
    return len(s) <= 24 + 4 * s.isascii() if _UNSPACED.search(s) else len(s.split()) <= 7 and len(s) <= 46


def rows_of_fields(lines: list[str]) -> tuple[float, str]:
    """Share of lines that are rows of delimited or aligned fields, with the delimiter."""
    best, which = 0.0, ""
    if len(lines) < 2:
        return best, which  # one line alone makes no rows
    # A line of several sentences is prose, whatever signs it holds.
    total = len(lines)
    lines = [x for x in lines if len(x) < 60 or len(_SENTENCE.findall(x)) < 2]
    if 2 * len(lines) <= total:
        return best, which
    for d in "|;\t,":
        # A comma before a blank is prose; the other signs count wherever they stand.
        counts = Counter(n for x in lines if d in x and (n := x.count(d) if d != "," else len(_COMMA.findall(x))))
        if counts:
            # Rows have about as many delimiters each; a ragged row still counts.
            top = counts.most_common(1)[0][0]
            share = sum(n for k, n in counts.items() if abs(k - top) <= max(1, top // 2)) / total
            if d == "," and top < 2:
                share *= 0.5
            if share > best:
                best, which = share, d
    if best < 0.99:
        share = sum("  " in x and bool(_ALIGNED.search(x)) for x in lines) / total
        if share > best:
            best, which = share, " "
    return best, which


def statistics(text: str | None, common: dict[str, bool]) -> dict[str, float]:
    """The statistics of one text. common: word -> whether its language has no blanks."""
    zero = dict.fromkeys(STATISTICS, 0.0) | {"n_words": 0, "n_lines": 0}
    text = normal(text or "")
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return zero
    n = len("".join(text.split())) or 1
    words = _WORDS.findall(text.lower())
    dense = len(_UNSPACED.findall(text))
    count = len(words)
    if dense > 0.2 * n:
        near = sum(text.count(w) * len(w) for w, unspaced in common.items() if unspaced) / n
        size = 2.0
        count = max(count, dense // 2)
    else:
        near = sum(w in common for w in words) / count if count else 0.0
        size = sum(map(len, words)) / count if count else 0.0
    fields, mark = rows_of_fields(lines)
    # A text without a long enough word cannot match.
    encoded = sum(len(m) for m in _ENCODED.findall(text) if any(c.isdigit() for c in m) and any(c.isalpha() for c in m) or len(set(m)) > 12) if max(map(len, text.split())) >= 28 else 0
    # Digits in pairs and words without vowels speak the less, the more of the words are common.
    rare = max(0.0, 1 - 5 * near)
    pairs = _HEX.findall(text) if rare else []
    hexed = rare * sum(map(len, pairs)) if sum(any(c in "abcdef" for c in p) for p in pairs) > 0.25 * len(pairs) else 0
    soup = rare * sum(len(w) for w in _SOUP.findall(text) if len(set(w)) > 2) if rare else 0
    broken = len(_BROKEN.findall(text.replace(mark, " ") if fields > 0.5 and mark.strip() else text))
    # One odd sign is a slip; many stand for as much damaged text around them.
    broken *= 4 * broken**2 / (broken**2 + 16)
    signs = max(0, n - sum(map(len, words)))
    noise = signs if signs > 0.6 * n and not any(_RULED.match(x) for x in lines) else 0
    damage = min(1.0, (max(encoded, hexed if hexed > 0.5 * n else 0) + soup + broken + noise) / n)
    raw = text.encode("utf-8", "replace")
    ratio = len(zlib.compress(raw, 1)) / len(raw)
    lengths = [len(x) for x in lines]
    again = (len(lines) - len(set(x.strip() for x in lines))) / (len(lines) + 1)
    dense_text = "".join(text.split())
    period = dense_text.find(dense_text[: min(16, len(dense_text) // 4)], 1) if len(dense_text) >= 12 else -1
    if period > 0 and len(dense_text) >= 4 * period and dense_text[period:] == dense_text[:-period]:
        again = 1.0
    repeated = max(again, min(1.0, max(0.0, 0.12 - ratio) / 0.08))
    return {
        "words": float(np.log1p(count)), "word_length": min(size, 40.0), "symbols": signs / n, "line_ends": sum(map(ended, lines)) / len(lines), "common": near,
        "entries": (entry(lines[0], len(lines) > 1) + sum(map(entry, lines[1:]))) / len(lines), "fields": fields, "damage": damage, "repeated": repeated, "line_length": float(np.log1p(sum(lengths) / len(lengths))), "n_words": count, "n_lines": len(lines),
    }


# Inspected examples, written for this purpose: one or more of each kind that the shapes comprise.
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "The keeper opened the door before noon. Nobody was there, so she went back to the house and waited for the others."),
    ("prose", "“Who is there?”\n“Only me.”\nThe keeper opened the door.\n“You are late,” she said."),
    ("prose", "Der Mann ging am Morgen auf den Markt und kaufte ein Brot.\nAm Abend war er nicht zu Hause, denn es gab viel zu tun."),
    ("prose", "她在中午之前打开了门。没有人在那里，所以她回到屋里等其他人。\n天黑以后他们都到了。"),
    ("prose", "彼女は昼前に扉を開けた。誰もいなかったので、家に戻って待っていた。"),
    ("prose", "그녀는 정오 전에 문을 열었다. 아무도 없어서 집으로 돌아가 기다렸다."),
    ("prose", "The keeper opened the door before noon and went\nback to the house, where she waited for all of the\nothers until the evening."),
    ("list", "- a lamp\n- two boxes\n- the old map\n- a letter\n- some paper"),
    ("list", "1. A lamp\n2. Two boxes\n3) The old map\n4. A letter"),
    ("list", "Opening .......... 3\nThe door .......... 9\nThe house ......... 14\nEvening ........... 20"),
    ("list", "lamp, 4, 17–19\nletter, 8, 21–25\nmap, 3, 40–44\npaper, 12, 71–73"),
    ("list", "Lamp: a thing that gives light in the dark\nMap: a drawing of the land from above\nBox: a thing to keep other things in"),
    ("list", "Anna Berg\nCarl Dahl\nEva Falk\nGerd Holm\nIda Jung"),
    ("list", "• 灯\n• 两个盒子\n• 旧地图\n• 一封信"),
    ("table", "|name|price|count|\n|lamp|20.50|3|\n|box|4.00|12|\n|map|7.25|1|"),
    ("table", "name;price;count\nlamp;20.50;3\nbox;4.00;12\nmap;7.25;1"),
    ("table", "name\tprice\tcount\nlamp\t20.50\t3\nbox\t4.00\t12\nmap\t7.25\t1"),
    ("table", "name      price     count\nlamp      20.50     3\nbox       4.00      12\nmap       7.25      1"),
    ("table", "name,price,count\nlamp,20.50,3\nbox,4.00,12\nmap,7.25,1"),
    ("junk", "q8Zt0PXkR4vGm2LwYc7NfB1sHd9JeUaT3oIx6KpQ5zVnSgMhCrEbWyFlAjD0uO+/\nq8Zt0PXkR4vGm2LwYc7NfB1sHd9JeUaT3oIx6KpQ5zVnSgMhCrEbWyFlAjD0uO=="),
    ("junk", "4f2a9c01d7e3b85566aa10ff4f2a9c01d7e3b85566aa10ff4f2a9c01d7e3b85566aa10ff"),
    ("junk", "brtkz wqplm xdfgh zzkrt plmnb vcxzs dfghj klqwr tpsdf ghjkl zxcvb nmqwr"),
    ("junk", "+)~ #@!; ^^%$ }{ |\\ <>~~ `! *&^ %$# @!~ +=_ }{| :;? ,.~"),
    ("junk", "T~e k_e|er o»en^d t°e d=or b_fo~e n^on. N|bo_y w°s t~er_ a»d s=e w^nt b_ck t~ t|e ho°se."),
    ("junk", "å¥¹å\x9c¨ä¸­å\x8d\x88ä¹\x8bå\x89\x8dæ\x89\x93å¼\x80äº\x86é\x97¨ã\x80\x82"),
    ("junk", "T?e k??p?r �p?n?d t?? d??r b?f?�e n??n. N?b�d? w?s t?e?e."),
    ("junk", "0\n0\n0\n0\n0\n0\n0\n0\n0\n0\n0\n0"),
    ("junk", "Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found. Page not found."),
]

_STATS = pa.schema([("doc_id", pa.int64()), *((x, pa.float64()) for x in STATISTICS), ("n_words", pa.int64()), ("n_lines", pa.int64())])


def common_words(spark: SparkSession, sf_dir: str) -> dict[str, bool]:
    spaced = table(spark, sf_dir, "languages").select("lang", "spaced")
    rows = table(spark, sf_dir, "common_words").join(F.broadcast(spaced), "lang", "left").select("word", "spaced")
    return {r.word: r.spaced is False for r in bounded(rows, 10_000, "common_words") if r.word}


def document_statistics(df: DataFrame, common: dict[str, bool], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, statistics, n_words, n_lines) of every row."""

    def each(k, t):
        s = statistics(t, common)
        return [(k, *(s[x] for x in STATISTICS), s["n_words"], s["n_lines"])]

    return map_rows(df, [key, text], each, _STATS, ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in _STATS))


#: Shares in [0, 1] are taken as log odds, the others here as logarithms; the constants keep both ends finite.
_ODDS, _LOGS = ("entries", "fields", "line_ends", "repeated"), ("damage", "symbols", "common")


def opened(x: np.ndarray) -> np.ndarray:
    """Rows of statistics on the open scale that the mixture is fitted on."""
    y = np.array(x, float)
    for c in _ODDS:
        v = np.clip(y[:, STATISTICS.index(c)], 0, 1)
        y[:, STATISTICS.index(c)] = np.log((v + 0.08) / (1.08 - v))
    for c in _LOGS:
        y[:, STATISTICS.index(c)] = np.log(y[:, STATISTICS.index(c)] + 0.03)
    return y


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return opened(np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS], 1))


def _log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """log weight + log density of every row under every component."""
    return np.stack([np.log(w) - 0.5 * (((x - m) ** 2 / v).sum(1) + np.log(v).sum()) for w, m, v in zip(weights, means, variances)], 1)


def _posterior(x: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, log likelihood) of every row."""
    joint = _log_joint(x, *model)
    top = joint.max(1, keepdims=True)
    p = np.exp(joint - top)
    total = p.sum(1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def _summed(df: DataFrame, each, names: list[str]) -> list:
    """each(rows) -> {name: array}, summed over all batches by place: one row per place reaches the driver."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = each(_rows(batch))
                total = found if total is None else {k: total[k] + v for k, v in found.items()}
        if total is not None:
            flat = {k: np.ravel(v) for k, v in total.items()}
            n = max(map(len, flat.values()))
            cols = [pa.array(np.arange(n))] + [pa.array(np.pad(flat[k], (0, n - len(flat[k])))) for k in names]
            yield pa.RecordBatch.from_arrays(cols, names=["i", *names])

    ddl = "i long, " + ", ".join(f"{k} double" for k in names)
    return df.select(*STATISTICS).mapInArrow(run, ddl).groupBy("i").agg(*(F.sum(k).alias(k) for k in names)).orderBy("i").collect()


class Mixture:
    """A fitted mixture with the shape of each component. passes and likelihood tell how the fit ended."""

    def __init__(self, centre, scale, model, shapes, passes=0, likelihood=0.0):
        self.centre, self.scale, self.model, self.shapes = centre, scale, model, shapes
        self.passes, self.likelihood = passes, likelihood

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """Posterior of every shape, in the order of SHAPES; x on the open scale."""
        return _posterior((x - self.centre) / self.scale, self.model)[0] @ self.shapes


def fit(stats: DataFrame, common: dict[str, bool], components: int = COMPONENTS, passes: int = PASSES, gain: float = GAIN) -> Mixture:
    """Expectation-maximisation over all rows of stats that hold words or signs. It starts at examples of each shape."""
    worded = stats.where("n_lines > 0")
    seen = opened(np.array([[statistics(t, common)[c] for c in STATISTICS] for _, t in EXAMPLES]))
    names = np.array([SHAPES.index(s) for s, _ in EXAMPLES])
    width = len(STATISTICS)
    first = _summed(worded, lambda x: {"n": np.full(width, float(len(x))), "s": x.sum(0), "q": (x * x).sum(0)}, ["n", "s", "q"])
    total = first[0].n if first else 0.0
    # The examples count as rows of the corpus, so that no scale is zero.
    n = total + len(seen)
    centre = (np.array([r.s for r in first] or [0.0] * width) + seen.sum(0)) / n
    scale = np.sqrt(np.maximum((np.array([r.q for r in first] or [0.0] * width) + (seen**2).sum(0)) / n - centre**2, 2.5e-3))
    z = (seen - centre) / scale
    # Starting means: examples as far apart as possible, at least one of each shape (farthest-point order).
    picked = [int(np.flatnonzero(names == s)[0]) for s in range(len(SHAPES))]
    while len(picked) < min(components, len(z)):
        gap = np.min([((z - z[i]) ** 2).sum(1) for i in picked], axis=0)
        picked.append(int(gap.argmax()))
    k = len(picked)
    start = z[picked].copy()
    means, weights, variances = start, np.full(k, 1 / k), np.full_like(start, 0.5)
    likelihood, done, before = 0.0, 0, -np.inf
    while total:
        model = (weights, means, variances)

        def step(x, model=model):
            x = (x - centre) / scale
            p, l = _posterior(x, model)
            return {"w": p.sum(0), "s": p.T @ x, "q": p.T @ (x * x), "l": np.array([l.sum()])}

        sums = _summed(worded, step, ["w", "s", "q", "l"])
        likelihood = sums[0].l / total
        if likelihood - before < gain:
            break
        if done == passes:
            raise RuntimeError(f"the mixture still gains {likelihood - before} after {done} passes")
        before, done = likelihood, done + 1
        w = np.array([r.w for r in sums[:k]])
        s, q = (np.array([r[c] for r in sums[: k * width]]).reshape(k, width) for c in ("s", "q"))
        held = (w + PRIOR)[:, None]
        means = (s + PRIOR * start) / held
        variances = (q - 2 * means * s + means**2 * w[:, None] + PRIOR * (0.25 + (start - means) ** 2)) / held + FLOOR
        weights = (w + 1) / (w + 1).sum()
    model = (weights, means, variances)
    votes = np.zeros((k, len(SHAPES)))
    for p, s in zip(_posterior(z, model)[0], names):
        votes[:, s] += p / (names == s).sum()
    # The example that a component started from has a word too, should no example be near any more.
    votes[np.arange(k), names[picked]] += 1e-3
    return Mixture(centre, scale, model, votes / votes.sum(1, keepdims=True), done, likelihood)


def shapes(stats: DataFrame, mixture: Mixture) -> DataFrame:
    """stats with the posterior of each shape, and the shape of the largest."""
    fields = [f"p_{s}" for s in SHAPES]
    names = [f.name for f in _STATS]

    def each(batches):
        for batch in batches:
            p = mixture.posteriors(_rows(batch)) if batch.num_rows else np.empty((0, len(SHAPES)))
            lines = batch.column(names.index("n_lines")).to_pylist()
            out = [SHAPES[k] if n else None for n, k in zip(lines, p.argmax(1).tolist() if len(p) else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(len(SHAPES))), pa.array(out, pa.string())], names=[*names, *fields, "shape"])

    ddl = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in _STATS)
    return stats.select(*names).mapInArrow(each, ddl + ", " + ", ".join(f"{f} double" for f in fields) + ", shape string")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, posteriors and shape of every document."""
    common = common_words(spark, sf_dir)
    stats = checkpointed(document_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), common))
    return shapes(stats, fit(stats, common))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are not prose."""
    return p8_statistics(spark, sf_dir).where("shape is not null and shape <> 'prose'").select("doc_id", "shape")
