"""Problem 5: the language of each document and of each stretch of lines, by compression.

Method: for every language a zstandard raw-content dictionary holds a bounded sample of its text. A line is compressed
with the dictionary of each language whose script it uses; the smallest output names the language, and a narrow margin
rejects the line. The lines of one document are then read together: the cheapest labelling (bytes, plus a fixed price for
each change of language) gives maximal segments, so rejected lines follow their neighbours.

Training: the dictionaries come from a bounded sample of labelled rows (the SAMPLE_ROWS rows of the smallest hashes in
SAMPLE_FILES files; a dictionary keeps at most DICTIONARY_BYTES). Labels are checked first: a sampled line counts only if
its script fits its label and its common words name no other language. Texts are read whole where they lie; only the lines
of the dictionaries, at most DICTIONARY_BYTES a language, come to the driver and travel with the tasks.

A line whose script leaves one language (Thai, Korean, ...) is not compressed: there is nothing to compare. A rejected
line takes the language of its neighbours, and the confidence of a segment says how clear its lines were.

Defined results: null, empty and wordless texts have no segment; a document delivered twice counts once; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, map_rows, normal, spread, table
from .markup import TEXT, plain, scan

SAMPLE_ROWS = 4_000
#: The sample is taken from at most so many files of the table, picked by a hash of their names.
SAMPLE_FILES = 64
DICTIONARY_BYTES = 48 * 1024
LEVEL = 3
#: Bytes that a change of language between two lines must save; a margin under REJECT of the size is narrow.
SWITCH = 7
REJECT = 0.04

# Unicode blocks of the scripts, by ISO 15924 code.
SCRIPTS = {
    "Latn": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ",
    "Hani": "々〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f",
    "Kana": "ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿｦ-ﾝ",
    "Hang": "ᄀ-ᇿ㄰-㆏가-힯",
    "Cyrl": "Ѐ-ԯ",
    "Arab": "ؠ-يٮ-ۓۺ-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ",
    "Thai": "ก-ฺเ-๎",
}
_OF_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_SCRIPTED = {"Latn": "Latn", "Hani": "Hani", "Jpan": "Kana", "Kore": "Hang", "Cyrl": "Cyrl", "Arab": "Arab", "Thai": "Thai"}
#: Beside another script only words in small letters are Latin text; the rest are names and units.
_LOWER = re.compile(r"(?<![A-Za-z.])[a-zß-öø-ÿ][A-Za-zÀ-ɏ]*")
_WORDS = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"\s+")
#: Up to three capitalised words or initials: a name, as far as anybody can tell.
_NAMES = re.compile(r"\W*(?:[A-ZÀ-ÖØ-Þ][\w.]*(?:\W+|$)){1,3}")


def weights(text: str) -> dict[str, int]:
    """Letters by script; one sign of a script without alphabet says as much as about three letters."""
    if text.isascii():
        n = sum(map(text.count, "etaoinsrhldcumfpgwybvkxjqzETAOINSRHLDCUMFPGWYBVKXJQZ"))
        return {"Latn": n} if n else {}
    found = {k: len(p.findall(text)) * (3 if k in ("Hani", "Kana", "Hang") else 1) for k, p in _OF_SCRIPT.items()}
    found = {k: n for k, n in found.items() if n}
    if len(found) > 1 and "Latn" in found:
        found["Latn"] = sum(map(len, _LOWER.findall(text)))
    return found


class Languages:
    """Compressors by language. languages: rows (lang, script); texts: a dictionary's content by language."""

    def __init__(self, languages: list[tuple[str, str]], texts: dict[str, bytes]):
        self.script = {k: _SCRIPTED.get(s, s) for k, s in languages}
        self.texts = texts
        self.by: dict[str, list[str]] = defaultdict(list)
        for k, s in self.script.items():
            self.by[s].append(k)
        self._made: dict[str, zstandard.ZstdCompressor] = {}

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def compressor(self, lang: str) -> zstandard.ZstdCompressor:
        if lang not in self._made:
            data = zstandard.ZstdCompressionDict(self.texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self._made[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._made[lang]

    def candidates(self, text: str) -> list[str]:
        """The languages written in the script of most of the text; Han signs are Chinese or Japanese."""
        found = weights(text)
        if not found:
            return []
        east = found.get("Hani", 0) + found.get("Kana", 0)
        other = {k: n for k, n in found.items() if k not in ("Hani", "Kana")}
        top = max(other, key=other.__getitem__) if other else ""
        if east >= other.get(top, 0):
            return self.by["Kana"] + self.by["Hani"] if found.get("Kana", 0) * 20 < found.get("Hani", 0) else self.by["Kana"] or self.by["Hani"]
        return self.by.get(top, [])

    def sizes(self, text: str) -> dict[str, float]:
        """Compressed bytes by candidate language; the smallest is the best. A lone candidate costs nothing."""
        names = self.candidates(text)
        if len(names) < 2:
            return dict.fromkeys(names, 0.0)
        data = _BLANKS.sub(" ", text).strip().encode()
        return {k: float(len(self.compressor(k).compress(data))) for k in names if k in self.texts}

    def segments(self, content: str | None) -> list[tuple[int, int, str, float, int]]:
        """(first line, last line, language, confidence, letters) of each maximal run of lines in one language."""
        if not content:
            return []
        lines = normal(content).split("\n")
        at: list[int] = []
        cost: list[dict[str, float]] = []
        size: list[int] = []
        loose: list[bool] = []
        for i, (line, kind) in enumerate(zip(lines, scan(lines))):
            if kind != TEXT:
                continue
            text = plain(line) if not line.isalnum() else line
            costs = self.sizes(text)
            if costs and not _only_names(text):
                at.append(i)
                cost.append(costs)
                size.append(len(text))
                loose.append(bool(_NAMES.fullmatch(text)) and len(costs) > 1 and max(costs.values()) - min(costs.values()) <= 2)
        if not at:
            return []
        names = self._cheapest(cost, loose)
        out: list[tuple[int, int, str, float, int]] = []
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and names[j + 1] == names[i]:
                j += 1
            out.append((at[i], at[j], names[i], self._confidence(names[i], cost[i : j + 1], size[i : j + 1]), sum(size[i : j + 1])))
            i = j + 1
        return out

    @staticmethod
    def _confidence(name: str, costs: list[dict[str, float]], sizes: list[int]) -> float:
        """How much smaller the chosen output is than the next best, averaged over the lines by their letters.

        A line whose script leaves no other language counts 1, a line of another language 0.
        """
        sure = 0.0
        for c, n in zip(costs, sizes):
            second = min((v for k, v in c.items() if k != name), default=0.0)
            if name in c:
                sure += n * (min(1.0, max(0.0, 1 - c[name] / second)) if second else 1.0)
        return round(sure / sum(sizes), 4)

    @staticmethod
    def _cheapest(cost: list[dict[str, float]], loose: list[bool]) -> list[str]:
        """The labelling of least bytes and switches. A loose line, a name alone, may stand in any language."""
        sure = [min(c, key=c.__getitem__) for c in cost]
        firm = {k for k, free in zip(sure, loose) if not free}
        if len(firm or set(sure)) == 1:
            return [*(firm or set(sure))] * len(sure)
        names = sorted({k for c in cost for k in c})
        best: dict[str, float] = dict.fromkeys(names, 0.0)
        back: list[dict[str, str]] = []
        for c, own, free in zip(cost, sure, loose):
            low = c[own]
            pick = min(best, key=best.__getitem__)
            floor = best[pick] + SWITCH
            new: dict[str, float] = {}
            step: dict[str, str] = {}
            for k in names:
                stay = best[k]
                step[k], base = (k, stay) if stay <= floor else (pick, floor)
                # A line that this language cannot have written costs far more than a switch.
                extra = c[k] - low if k in c else 10 * SWITCH
                new[k] = base + (0.0 if free or k in c and extra < REJECT * low else extra)
            back.append(step)
            best = new
        k = min(best, key=best.__getitem__)
        out = []
        for step in reversed(back):
            out.append(k)
            k = step[k]
        return out[::-1]


def _only_names(text: str) -> bool:
    """Single names do not count: up to three words, all Latin and capitalised, as in a list of people."""
    words = _WORDS.findall(text)
    return not any(len(w) > 1 for w in words) and text.isascii()


def _checked(line: str, lang: str, languages: Languages, common: dict[str, set[str]]) -> bool:
    """Whether a sampled line may train a language: its script fits, its common words name no other language."""
    names = languages.candidates(line)
    if lang not in names:
        return False
    if len(names) == 1:
        return True
    words = Counter(w.lower() for w in _WORDS.findall(line)) if languages.script[lang] == "Latn" else None
    votes = {k: sum(words[w] for w in common.get(k, ())) if words is not None else sum(line.count(w) for w in common.get(k, ())) for k in names}
    return votes[lang] > 0 and votes[lang] >= max(votes.values())


_LINES = pa.schema([("lang", pa.string()), ("line", pa.string()), ("size", pa.int64())])


def fit(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Languages:
    """Dictionaries from a sample of `rows` labelled documents, those with the smallest hashes of their ids."""
    languages = [(r.lang, r.script) for r in bounded(table(spark, sf_dir, "languages").select("lang", "script"), 1_000, "languages") if r.lang]
    common: dict[str, set[str]] = defaultdict(set)
    for r in bounded(table(spark, sf_dir, "common_words").select("lang", "word"), 10_000, "common_words"):
        common[r.lang].add(r.word)
    model = Languages(languages, {})
    documents = table(spark, sf_dir, "documents")
    names = documents.inputFiles()
    if len(names) > SAMPLE_FILES:
        documents = spark.read.schema(documents.schema).parquet(*sorted(names, key=lambda n: zlib.crc32(n.rpartition("/")[2].encode()))[:SAMPLE_FILES])
    labelled = documents.select(F.xxhash64("doc_id").alias("hash"), F.lower(F.trim("lang")).alias("lang"), "text").where(F.col("lang").isin([k for k, _ in languages]) & F.col("text").isNotNull())
    # The hash of the last row of the sample: numbers only are moved to find it.
    last = labelled.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]

    def each(lang, text):
        lines = normal(text).split("\n")
        found = (_BLANKS.sub(" ", plain(x)).strip() for x, kind in zip(lines, scan(lines)) if kind == TEXT)
        return [(lang, x, n + 1) for x in found if x and (n := len(x.encode())) < dictionary_bytes and _checked(x, lang, model, common)]

    texts: dict[str, list[bytes]] = defaultdict(list)
    if last is not None:
        lines = map_rows(labelled.where(F.col("hash") <= last), ["lang", "text"], each, _LINES, "lang string, line string, size long")
        # Lines of the sample, a bounded number, by a hash of their own until a dictionary is full.
        order = Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line")
        held = lines.groupBy("line").agg(F.min("lang").alias("lang"), F.max("size").alias("size")).withColumn("upto", F.sum("size").over(order))
        for r in held.where(F.col("upto") <= dictionary_bytes).orderBy("lang", "upto").collect():
            texts[r.lang].append(r.line.encode())
    for lang, _ in languages:
        # The common words stand last, where matches cost least; they also serve a language without a sample.
        model.texts[lang] = b"\n".join([*texts[lang], " ".join(sorted(common.get(lang, {lang}))).encode()])
    return model


SEGMENTS = pa.schema([("file_id", pa.int64()), ("src_lang", pa.string()), ("segment", pa.int32()), ("segments", pa.int32()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64())])


def segments(files: DataFrame, model: Languages) -> DataFrame:
    """One row per file and segment. Files delivered again give equal rows; take them distinct."""

    def each(file_id, src_lang, content):
        found = model.segments(content)
        return [(file_id, src_lang, i, len(found), *x) for i, x in enumerate(found)]

    return map_rows(files, ["file_id", "src_lang", "content"], each, SEGMENTS, "file_id long, src_lang string, segment int, segments int, first_line long, last_line long, lang string, confidence double, letters long")


def named(labels: DataFrame, languages: DataFrame) -> DataFrame:
    """Adds `named`, the language that src_lang names by any column of languages; case, blanks and region aside."""
    names = languages.select("lang", F.explode(F.array("lang", "label", "name_en", "iso3")).alias("name")).select(F.col("lang").alias("named"), F.lower(F.trim("name")).alias("_name")).dropDuplicates(["_name"])
    key = F.regexp_replace(F.lower(F.regexp_replace("src_lang", r"(?U)^\s+|\s+$", "")), r"^([a-z]{2,3})[-_][a-z0-9_-]+$", "$1")
    return labels.withColumn("_name", key).join(F.broadcast(names), "_name", "left").drop("_name")  # languages: 12 fixed rows


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's segments with language and confidence."""
    return segments(spread(table(spark, sf_dir, "files").select("file_id", "src_lang", "content")), fit(spark, sf_dir)).drop("src_lang", "segments").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of files whose label names no language, or another than the content's, or that mix languages."""
    found = segments(spread(table(spark, sf_dir, "files").select("file_id", "src_lang", "content")), fit(spark, sf_dir))
    found = named(found, table(spark, sf_dir, "languages"))
    wrong = F.col("named").isNull() | (F.col("segments") > 1) | (F.col("named") != F.col("lang"))
    return found.where(wrong).select("file_id", "first_line", "last_line", "lang").distinct()
