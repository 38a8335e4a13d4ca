"""Problem 2: sentence units of texts in any language and line layout.

Method: the boundary rules are compiled into a finite transducer. A lexer with bounded look-around turns the text into
symbols (words, terminal stops, colons, opening and closing quotes and brackets, line breaks that end or continue a
sentence); the transducer's states remember the open quote or bracket (two levels), how it was opened and whether it
ended with a stop. A symbol met in a start state begins a unit. The chunks of a text above one chunk are spread over the
cluster and lexed once; each becomes a function from entry state to exit state, with the units that begin in it for every
entry state (few differ, as a line's end resets the transducer). The functions are composed by a parallel prefix scan: up a
tree of FAN chunks a node, three levels for the longest string there can be, and down again with entry states, which then
pick each chunk's units.

Every non-blank character belongs to one unit. Defined results: null, empty and blank texts have no unit; offsets count
code points of the normalised text; a document delivered twice gives equal rows, kept once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, normal, normal_column, slices, spread, table, tasks

CHUNK = 8192
MARGIN = 512
#: How far a decision looks around; the rest of the margin is for blanks beside it.
LOOK = 384
#: Lines at least this long can be wrapped lines; beyond the other they are paragraphs.
WRAP = (24, 100)
SLACK = 3
FAN = 64

# Abbreviations that do not end a sentence, without their stop, in small letters.
TITLES = set(
    "mr mrs messrs ms dr prof st sr sra srta dra drs hr fr frl m mm mme mlle me sig sigg sra dott dottssa ing avv on rev hon gen gov sen col maj cmdr adm capt lt sgt al av avda rua via ul pl ave blvd rd "
    "d.h z.b u.a i.e e.g ca approx env aprox circa ca. vs cf vgl bzw usw inkl evtl sog bes ggf "
    "проф г гг ул им т.е т.д т.п д-р г-н г-жа тов стр рис см напр пр обл пер пл "
    "د ص أ م ดร กก น นาย พ.ศ".split()
)
NUMBERED = set("no nos nr núm num n nº p pp pag págs pág s abb fig figs abs art kap cap ch chap chaps sec secs sect sects para paras vol bd ed aufl taf tab eq стр рис гл п табл h".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Thai words that carry a sentence on after a blank.
THAI_GO = ("กับ", "และ", "หรือ", "ที่", "ซึ่ง", "ใน", "ของ", "โดย", "จาก", "ถึง", "แต่", "ว่า", "รุ่น", "มา", "กก.", "น.", "บันทึก", "เมื่อ", "เพื่อ", "ไป", "เป็น", "อยู่")

_TITLED = re.compile(r"(?:นาย|นาง|นางสาว|คุณ|ดร\.|ศ\.|ศาสตราจารย์)\s*[A-Za-z]+$")

STOPS = ".!?。！？…؟।｡"
_OPENQ, _CLOSEQ = "«「『‹《〈", "”»」』›》〉"
_OPENB, _CLOSEB = "([{（［【｛", ")]}）］】｝"
_LEX = re.compile(
    rf"(?P<nl>[^\S\n]*\n\s*)|(?P<sp>[^\S\n]+)|(?P<t>[{STOPS}]+)|(?P<c>[:：])|(?P<lq>“)|(?P<gq>„)|(?P<oq>[{_OPENQ}])|(?P<cq>[{_CLOSEQ}])|(?P<sq>\")"
    rf"|(?P<ob>[{re.escape(_OPENB)}])|(?P<cb>[{re.escape(_CLOSEB)}])|[^\s{STOPS}:：“„\"{_OPENQ}{_CLOSEQ}{re.escape(_OPENB + _CLOSEB)}]+"
)
_BACK = re.compile(r"[\w.'-]*$")
_WORD = re.compile(r"\w+")
_BULLET = re.compile(r"[-–—•·・*+▪◦‣]\s|\d{1,3}[.)]\s|\d+$|\(?[a-zA-Z]\)\s|>|#|\|")
_DAY = re.compile(r"\d{1,2}\. (\w+)")
_COMMA = set(",，、;；、،؛-–—")

# Symbols.
WORD, TERM, COLON, OQ, GQ, LQ, SQ, OB, BLANK, GO, END = range(11)
# Closing quotes, left quotes that may close a German one, straight quotes and brackets, each with what follows:
_AFTER = ("go", "att", "new", "nl", "thai")
CQ, LC, SC, CB = 11, 16, 21, 26
SYMBOLS = 31


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _spaced(c: str) -> bool:
    """Whether a sign belongs to a script with blanks between words."""
    return c.isascii() or _cased(c) or "가" <= c <= "힣" or "\u0590" <= c <= "\u08ff"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _next(text: str, i: int) -> tuple[str, bool, bool]:
    """(next non-blank character or '', whether blanks lie before it, whether a line break does)."""
    n, j = len(text), i
    while j < n and text[j].isspace():
        j += 1
    return (text[j] if j < n else ""), j > i, "\n" in text[i:j]


def _terminal(text: str, i: int, j: int) -> bool:
    """Whether the stops text[i:j] may end a sentence, from what stands around them."""
    run = text[i:j]
    if any(c in "。！？؟।｡" for c in run):
        return True
    c, gap, newline = _next(text, j)
    if not c:
        return True
    if c in "”»」』›》〉\"“)]}）］】’'" and not gap:
        return True
    if run.strip("…") == "" or len(run) > 1 and set(run) == {"."}:
        return gap and not c.islower() or newline and not c.islower()
    if "!" in run or "?" in run:
        return not (c.islower() or c in _COMMA) if gap else not c.islower() and c not in _COMMA
    # One full stop.
    before = _BACK.search(text[max(0, i - 24) : i])[0].lstrip(".'-")
    last = before[-1:]
    if not gap:
        if c.isalpha() and last.isalpha():
            word = before.rpartition(".")[2]
            if c.isupper():
                return len(word) > 1 and last.islower() and "." not in before and word.lower() not in TITLES
            return not _cased(c) and not _cased(last) and len(word) > 1
        return last.isdigit() and c.isupper() and not c.isdigit()
    if c.islower() or c in _COMMA:
        return False
    word = before.lower()
    tail = word.rpartition(".")[2]
    if word in TITLES or tail in TITLES or len(tail) == 1 and tail.isalpha():
        return False
    if c.isdigit() and (tail in NUMBERED or word in NUMBERED):
        return False
    if before.isdigit():
        line = text.rfind("\n", 0, i) + 1
        if not text[line : i - len(before)].strip() and len(before) <= 3:
            return False
        m = _WORD.search(text, j)
        if len(before) <= 2 and m and m[0].lower() in MONTHS:
            return False
    return True


def _goes_on(text: str, i: int, j: int) -> bool:
    """Whether a sentence may run over the single line break text[i:j] between two non-blank characters.

    It does before a small letter, after a stop that ends nothing, and where the next word would not have fitted into
    the lines of its block, which is how wrapping leaves them.
    """
    line = text.rfind("\n", 0, i) + 1
    if line == i:
        return False  # an empty line, or the edge of a chunk's margin
    c = text[j]
    held = text[max(line, i - LOOK) : i]
    german = held.count("„")
    if sum(map(held.count, "«「『(（[【")) + (german or held.count("“")) > sum(map(held.count, "»」』)）]】")) + (held.count("“") + held.count("”") if german else held.count("”")):
        return True  # the line leaves a quotation or a bracket open
    if held[-1] in ":：" and c in _OPENQ + "“„\"":
        return True
    if m := _DAY.match(text, j):
        if m[1].lower() in MONTHS:
            return True
    if _BULLET.match(text, j):
        return False
    if c.islower():
        return True
    if _BULLET.match(text, line):
        return False
    if text[i - 1] == "." and not _terminal(text, i - 1, i):
        return True
    first = max(0, text.rfind("\n\n", max(0, i - LOOK), i) + 2, i - LOOK if i > LOOK and "\n\n" not in text[i - LOOK : i] else 0)
    last = text.find("\n\n", j, j + LOOK)
    width = max(map(len, text[first : last if last > 0 else j + LOOK].split("\n")))
    if not WRAP[0] <= width <= WRAP[1]:
        return False
    end = j + 1
    while end < len(text) and not text[end].isspace() and _spaced(text[end]):
        end += 1
    # What was put in after wrapping may have made one line a little longer than the rest.
    return i - line + _spaced(text[i - 1]) + end - j > width - (SLACK if _spaced(c) else 1)


def _after(text: str, j: int) -> int:
    """What follows a closing mark: go, att, new, nl or thai."""
    c, gap, newline = _next(text, j)
    if newline and c:
        end = j
        while text[end].isspace():
            end += 1
        if text.count("\n", j, end) == 1 and _goes_on(text, j + len(text[j:end]) - len(text[j:end].lstrip(" \t")), end):
            newline, gap = False, _cased(c) or "가" <= c <= "힣" or _thai(c)
    if newline or not c:
        return 3
    if gap and _thai(c):
        return 4
    if c in _COMMA or c.islower() or c in ".!?。！？…:：)）]】":
        return 0
    if gap or c.isupper() or c in _OPENQ + "“„\"" + _OPENB + "¿¡":
        return 2
    return 1


def lex(text: str) -> list[tuple[int, int]]:
    """(symbol, start) of everything that matters; no decision looks further than LOOK."""
    out: list[tuple[int, int]] = []
    add = out.append
    for m in _LEX.finditer(text):
        kind, i = m.lastgroup, m.start()
        if kind is None:
            add((WORD, i))
        elif kind == "sp":
            j = m.end()
            if j < len(text) and i and _thai(text[j]) and (_thai(text[i - 1]) or text[i - 1] in "”\"" or text[i - 1].isalnum()):
                # Between Thai words a blank ends a sentence; after a foreign word only where no particle carries on.
                if _thai(text[i - 1]) or text[i - 1] in "”\"" or text[i - 1].isalpha() and not text.startswith(THAI_GO, j) and not _TITLED.search(text[max(0, i - 48) : i]):
                    add((TERM, i))
            elif j < len(text) and i and _thai(text[i - 1]) and text[j] in "“":
                add((TERM, i))
        elif kind == "t":
            add((TERM if _terminal(text, i, m.end()) else WORD, i))
        elif kind == "nl":
            if m[0].count("\n") > 1:
                add((BLANK, i))
                continue
            j = m.end()
            if j >= len(text):
                continue
            go = _goes_on(text, i, j)
            add((GO if go else END, i))
        elif kind == "c":
            add((COLON, i))
        elif kind == "oq":
            add((OQ, i))
        elif kind == "gq":
            add((GQ, i))
        elif kind == "lq":
            add((LC + _after(text, m.end()), i))
        elif kind == "cq":
            add((CQ + _after(text, m.end()), i))
        elif kind == "sq":
            add((SC + _after(text, m.end()), i))
        elif kind == "ob":
            add((OB, i))
        else:
            add((CB + _after(text, m.end()), i))
    return out


# States. Outside: START (nothing yet), PEND (a sentence ended), OUT, AFTER_COLON. Inside: a stack of at most two of
# (what closes it, how it was opened, whether the last thing in it was a stop).
_START, _PEND, _OUT, _COLON = ("start",), ("pend",), ("out",), ("colon",)


def _step(state: tuple, symbol: int) -> tuple[tuple, bool]:
    """(next state, whether the symbol begins a unit)."""
    if symbol == BLANK or symbol == END:
        return _START, False
    if symbol == GO:
        return state, False
    after = None
    kind = symbol
    if symbol >= CQ:
        kind, after = CQ + (symbol - CQ) // 5 * 5, (symbol - CQ) % 5
    if isinstance(state[0], str):
        fresh = state in (_START, _PEND)
        how = "start" if fresh else "colon" if state is _COLON or state == _COLON else "mid"
        opens = {OQ: "q", GQ: "g", LC: "q", SC: "s", OB: "b"}.get(kind)
        if opens:
            return ((opens, how, False),), fresh
        if kind == TERM:
            return (_PEND, False) if state != _START else (_PEND, True)
        if kind in (CQ, CB):
            return (state, False) if state == _PEND else (_OUT, state == _START)
        if kind == COLON:
            return _COLON, fresh
        return _OUT, fresh
    top, how, ended = state[-1]
    rest = state[:-1]
    opens = {OQ: "q", GQ: "g", OB: "b"}.get(kind) or ("q" if kind == LC and top != "g" else "s" if kind == SC and top != "s" else None)
    closes = kind == CQ and top in "qg" or kind == LC and top == "g" or kind == SC and top == "s" or kind == CB and top == "b"
    if closes:
        if rest:
            t, h, e = rest[-1]
            return (*rest[:-1], (t, h, ended)), False
        if after == 4:
            return _PEND, False
        if not ended or after == 0:
            return _OUT, False
        if top == "b":
            return (_PEND if how == "start" else _OUT), False
        if after == 1:
            return (_PEND if how == "colon" else _OUT), False
        return _PEND, False
    if opens and len(state) < 2:
        return (*state, (opens, "mid", False)), False
    if kind == TERM:
        return (*rest, (top, how, True)), False
    return (*rest, (top, how, False)), False


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[bool]]]:
    """Tables next[state][symbol] and starts[state][symbol], as arrays and as lists; state 0 is the start."""
    states, queue = {_START: 0}, [_START]
    move, begins = [], []
    for s in queue:
        row = [_step(s, x) for x in range(SYMBOLS)]
        for t, _ in row:
            if t not in states:
                states[t] = len(states)
                queue.append(t)
        move.append([states[t] for t, _ in row])
        begins.append([b for _, b in row])
    return np.array(move, np.int16), np.array(begins, bool), move, begins


def run(symbols: list[tuple[int, int]], state: int = 0) -> tuple[list[int], int]:
    """Starts of the units that begin in these symbols, and the exit state."""
    _, _, move, begins = transducer()
    out = []
    for symbol, at in symbols:
        if begins[state][symbol]:
            out.append(at)
        state = move[state][symbol]
    return out, state


def function(symbols: list[tuple[int, int]]) -> tuple[list[int], list[int], list[list[int]]]:
    """The chunk as a function: (exit state by entry state, which starts by entry state, the different lists of starts)."""
    move, begins, *_ = transducer()
    reset = next((i for i, (x, _) in enumerate(symbols) if x in (BLANK, END)), len(symbols))
    v = np.arange(len(move), dtype=np.int16)
    rows = []
    for symbol, _ in symbols[:reset]:
        rows.append(begins[v, symbol])
        v = move[v, symbol]
    tail: list[int] = []
    if reset < len(symbols):
        # From here on every entry state runs alike.
        tail, state = run(symbols[reset:])
        v = np.full(len(move), state)
    if not rows:
        return v.tolist(), [0] * len(move), [tail]
    kinds, pick = np.unique(np.array(rows), axis=1, return_inverse=True)
    return v.tolist(), pick.ravel().tolist(), [[symbols[i][1] for i in np.flatnonzero(k).tolist()] + tail for k in kinds.T]


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every unit of a normalised text."""
    if not text.strip():
        return []
    starts, _ = run(lex(text))
    first = len(text) - len(text.lstrip())
    if not starts or starts[0] > first:
        starts.insert(0, first)
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        n = len(text[a:b].rstrip())
        if n:
            out.append((a, a + n))
    return out


_UNITS = pa.schema([("file_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def _short(df: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(k, x, y) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x, y in units(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=_UNITS)

    return df.mapInArrow(each, "file_id long, start_char long, end_char long")


_INTS, _LISTS = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))
_FOUND = pa.schema([("row", pa.int64()), ("file_id", pa.int64()), ("chunk", pa.int32()), ("f", _INTS), ("pick", _INTS), ("starts", _LISTS), ("befores", _LISTS), ("first", pa.int64()), ("last", pa.int64())])
_FOUND_DDL = "row long, file_id long, chunk int, f array<int>, pick array<int>, starts array<array<long>>, befores array<array<long>>, first long, last long"


def _chunked(df: DataFrame, chunk: int) -> DataFrame:
    """Per chunk its function, the starts of its units by entry state with the end of the text before each (-1 where only
    blanks of the margin lie before it), and its first and last non-blank places."""

    def each(row, key, n, text):
        base = max(0, n * chunk - MARGIN)
        exits, pick, starts = function([(s, base + at) for s, at in lex(text) if n * chunk <= base + at < (n + 1) * chunk])
        ends = [[base + len(t) if (t := text[: at - base].rstrip()) else -1 for at in x] for x in starts]
        body = text[n * chunk - base : (n + 1) * chunk - base]
        blank = not body.strip()
        return [(row, key, n, exits, pick, starts, ends, None if blank else n * chunk + len(body) - len(body.lstrip()), None if blank else n * chunk + len(body.rstrip()))]

    return map_rows(df, ["row", "file_id", "chunk", "text"], each, _FOUND, _FOUND_DDL)


def entry_states(functions: DataFrame) -> DataFrame:
    """(row, chunk, entry) from (row, chunk, f): the prefix scan. No node of the tree holds more than FAN functions."""
    node = functions.select("row", F.col("chunk").alias("n0"), "f")
    levels = []
    for k in (1, 2, 3):
        held = node.groupBy("row", F.expr(f"n{k - 1} div {FAN}").cast("int").alias(f"n{k}")).agg(F.sort_array(F.collect_list(F.struct(f"n{k - 1}", "f"))).alias("l"))
        levels.append(held)
        # Composition in order: what the node makes of every entry state.
        node = held.select("row", f"n{k}", F.expr("aggregate(slice(l, 2, size(l)), l[0].f, (a, x) -> transform(a, s -> x.f[s]))").alias("f"))
    entry = levels[2].select("row", "n3", F.lit(0).alias("entry"))
    for k in (3, 2, 1):
        down = levels[k - 1].join(entry, ["row", f"n{k}"])
        states = F.expr("aggregate(slice(l, 1, size(l) - 1), array(entry), (a, x) -> concat(a, array(x.f[element_at(a, -1)])))")
        entry = down.select("row", F.explode(F.arrays_zip(F.expr(f"transform(l, x -> x.n{k - 1})").alias("n"), states.alias("entry"))).alias("z")).select("row", F.col("z.n").alias(f"n{k - 1}"), "z.entry")
    return entry.withColumnRenamed("n0", "chunk")


def sentence_units(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(file_id, start_char, end_char) of every unit of every row's text. A chunk is at least MARGIN long."""
    rows = df.select(F.col(key).cast("long").alias("file_id"), normal_column(F.col(text)).alias("text")).where("text is not null and file_id is not null")
    short = _short(rows.where(F.length("text") <= chunk))
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "file_id", "text")
    # One pass cuts the text; every chunk takes the margins from its neighbours.
    cut = long.select("row", "file_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    with_margins = f"transform(c, (x, i) -> struct(i as chunk, concat(coalesce(right(get(c, i - 1), {MARGIN}), ''), x, coalesce(left(get(c, i + 1), {MARGIN}), '')) as text))"
    parts = cut.select("row", "file_id", F.explode(F.expr(with_margins)).alias("p")).select("row", "file_id", "p.chunk", "p.text").repartition(tasks(df), "row", "chunk")
    # Numbers only from here on; they are read twice, for the scan and for the units.
    chunks = checkpointed(_chunked(parts, chunk))
    found = chunks.join(entry_states(chunks.select("row", "chunk", "f")), ["row", "chunk"]).select("row", "file_id", "chunk", F.expr("starts[pick[entry]]").alias("found"), F.expr("befores[pick[entry]]").alias("before"), "first", "last")
    earlier = F.max("last").over(Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_e", F.coalesce(earlier, F.lit(0))).withColumn("before", F.expr("transform(before, x -> if(x < 0, _e, x))"))
    flat = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", c))), lambda x: x[c]))
    docs = found.groupBy("row", "file_id").agg(flat("found").alias("s"), flat("before").alias("b"), F.min("first").alias("first"), F.max("last").alias("last")).where("first is not null")
    # A text that opens with something that begins no unit still belongs to one.
    opened = F.coalesce(F.get("s", F.lit(0)) > F.col("first"), F.lit(True))
    starts = F.when(opened, F.concat(F.array("first"), "s")).otherwise(F.col("s"))
    ends = F.concat(F.when(opened, F.col("b")).otherwise(F.expr("slice(b, 2, size(b))")), F.array("last"))
    spans = docs.select("file_id", F.explode(F.arrays_zip(starts.alias("start_char"), ends.alias("end_char"))).alias("z")).select("file_id", "z.start_char", "z.end_char")
    return short.unionByName(spans.where("end_char > start_char"))


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every file."""
    return sentence_units(spread(table(spark, sf_dir, "files").select("file_id", "content")), "file_id", "content").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of the files in sentence_set."""
    wanted = table(spark, sf_dir, "sentence_set").select("file_id").distinct()
    files = table(spark, sf_dir, "files").select("file_id", "content").join(wanted, "file_id", "left_semi")
    return sentence_units(files, "file_id", "content").distinct()
