"""Secret scan: fixed credential patterns, and values in a credential's context judged by what guessing them costs.

Base kinds (`assign`, `access`, `hex`) are leftmost non-overlapping matches of their patterns; matches that fail the
length test are dropped. The added kind `guess` covers values after a credential word and a separator whose guess cost
is high: the cheapest segmentation of the value into common words, dates, repeats, keyboard walks, alphabet or digit
runs and brute-force spans, by dynamic programming; costs are log10 of guesses and add up. After `is`, where prose goes
on in plain words, values of one character class only (such as lower-case letters) are left out whatever they cost.

Spans are code points of the whole text, end exclusive. Null and empty texts have no spans. Rows are judged one by one,
so repeated rows and null ids just pass through; an empty table gives an empty result; very long texts and values are
judged whole; other columns are not carried, so clashing names can't arise. A narrow map without any shuffle: cheap
tests (substrings; runs of hex digits over all bytes of a batch, cut at row ends) leave the patterns to the few texts that can match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import read, slices, strings, utf8

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?ai)(?:pass(?:word|phrase|code|wd)?|pwd|secret|token|credentials?|(?:api|access|private)[_\x20-]?key)["']?\x20*(?::|=>?|\bis\b)\x20*["']?([^\s"'<>,;]{6,})""")
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")
#: A value is a secret from this guess cost on (log10 of guesses).
MIN_COST = 10.0

COMMON = (
    "password the and you that for this with have from one had word but not what all were when your can said there use an each which she how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part admin root user guest login welcome master dragon monkey letmein football baseball shadow sunshine princess hunter test changeme default secret token example sample your placeholder none null true false undefined value key api access private public home house love summer winter spring autumn january february march april june july august september october november december monday tuesday friday sunday orange apple banana purple green blue black white red silver gold star moon river mountain correct horse battery staple"
).split()
WORD_COST = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(COMMON)))}
LONGEST_WORD = max(map(len, COMMON))
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SPOT = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row) if c != " "}
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATES = tuple(re.compile(p) for p in (r"(?a)(?:19|20)\d\d", r"(?a)(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", r"(?a)(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"))
#: Longest unit of a repeat, and longest piece that may stop anywhere.
LONGEST_PIECE = 64


def _near(a: str, b: str) -> bool:
    p, q = SPOT.get(a), SPOT.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if "a" <= c <= "z" or "A" <= c <= "Z" else math.log10(33)


def _stops(start: int, least: int, most: int) -> Iterator[int]:
    """Ends of a piece from `start`: all lengths from `least` to LONGEST_PIECE, and as far as it goes."""
    yield from range(start + least, min(most, start + LONGEST_PIECE) + 1)
    if most > start + LONGEST_PIECE:
        yield most


def _dates(value: str) -> dict[int, list[int]]:
    """Where dates that begin at a place end, shorter ones included."""
    out: dict[int, list[int]] = {}
    for i in range(len(value)):
        if "0" <= value[i] <= "9":
            found = {m.end() for form in DATES if (m := form.match(value, i))}
            if found:
                out[i] = sorted(found)
    return out


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By place the widths up to LONGEST_PIECE of units that are repeated there, and how often; units that repeat a shorter unit themselves are left out."""
    points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    out: dict[int, list[tuple[int, int]]] = {}
    for width in range(1, min(LONGEST_PIECE, len(value) // 2) + 1):
        same = np.append(points[:-width] == points[width:], False)
        ends = np.flatnonzero(~same)
        run = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))  # how far each character equals the one `width` later
        for i in np.flatnonzero(run >= width).tolist():
            have = out.setdefault(i, [])
            if not any(width % w == 0 and t * w >= width for w, t in have):
                have.append((width, 1 + int(run[i]) // width))
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of `value` needs; 0 for the empty value.

    Pieces and their costs: a character by brute force (its class); a common word (its rank, 0.5 for taking a word, 0.3 each
    for capitals and for look-alike digits); a date; a walk of 4 or more neighbouring keys (its start, bends and length); a
    run of 3 or more letters or digits in order (start and length); a unit repeated to 3 or more characters (the unit's
    characters and log10 of the times). Walks, runs and repeats may stop anywhere up to LONGEST_PIECE characters, or go on as
    far as they do.
    """
    n = len(value)
    low = value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    dates, repeats = _dates(value), _repeats(value)
    # walk[i] / step[i] is where the keyboard walk / the alphabet or digit run from i stops
    walk, step = list(range(1, n + 1)), list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if _near(low[i], low[i + 1]):
            walk[i] = walk[i + 1]
        d = ord(low[i + 1]) - ord(low[i])
        if abs(d) == 1 and low[i].isalnum() and low[i + 1].isalnum():
            same = i + 2 < n and low[i + 2].isalnum() and ord(low[i + 2]) - ord(low[i + 1]) == d
            step[i] = step[i + 1] if same else i + 2
    turns = [0] * (n + 1)  # direction changes of the walk up to each position
    for i in range(1, n - 1):
        turns[i + 1] = turns[i] + (walk[i - 1] > i + 1 and _turn(low, i))
    chars = [0.0]
    for c in value:
        chars.append(chars[-1] + _char_cost(c))
    for i in range(n):
        base = best[i]

        def offer(stop: int, cost: float, base: float = base) -> None:
            if base + cost < best[stop]:
                best[stop] = base + cost

        offer(i + 1, _char_cost(value[i]))
        for stop in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            word = low[i:stop]
            cost = WORD_COST.get(word)
            if cost is None and plain[i:stop] != word and plain[i:stop] in WORD_COST:
                cost = WORD_COST[plain[i:stop]] + 0.3
            if cost is not None:
                offer(stop, cost + (0.3 if value[i:stop] != word else 0.0) + 0.5)
        for stop in dates.get(i, ()):
            offer(stop, math.log10(365.0 * 120) if stop - i > 4 else math.log10(120.0))
        for stop in _stops(i, 4, walk[i]):
            offer(stop, math.log10(47.0) + 0.6 * (turns[stop - 1] - turns[i + 1] + 1) + math.log10(stop - i))
        for stop in _stops(i, 3, step[i]):
            offer(stop, math.log10(52.0) + math.log10(stop - i))
        for width, most in repeats.get(i, ()):
            unit = chars[i + width] - chars[i]
            for times in {*range(2, min(most, max(2, LONGEST_PIECE // width)) + 1), most}:
                if times * width >= 3:
                    offer(i + times * width, unit + math.log10(times))
    return best[n]


def _turn(text: str, k: int) -> bool:
    a, b, c = SPOT[text[k - 1]], SPOT[text[k]], SPOT[text[k + 1]]
    return (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1])


def _classes(value: str) -> int:
    return sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^a-zA-Z0-9]", value))))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def guess_spans(text: str, min_cost: float = MIN_COST) -> list[tuple[str, int, int]]:
    out = []
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".!?)]}")
        prose = text[m.start() : m.start(1)].rstrip(" \"'")[-1] not in ":=>"
        if len(value) >= 6 and (not prose or _classes(value) >= 2) and guess_cost(value) >= min_cost:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return out


def scan(text: str, min_cost: float = MIN_COST) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind as listed in KINDS."""
    return sorted(base_spans(text) + guess_spans(text, min_cost), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _may_match(texts: list[str], column: pa.Array) -> list[bool]:
    """False only where neither base patterns nor contexts can match."""
    raw, offs = utf8(column)
    hexes = ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 102))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hexes.view(np.int8), [0]))))
    cuts = offs[1:-1]  # a row's end is a run's end, whatever comes next
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = np.unique(cuts[hexes[cuts - 1] & hexes[cuts]])
    starts, stops = np.sort(np.concatenate([edges[0::2], cuts])), np.sort(np.concatenate([edges[1::2], cuts]))
    starts = starts[stops - starts >= 24]
    flagged = np.zeros(len(texts), bool)
    flagged[np.searchsorted(offs, starts, side="right") - 1] = True
    for i, text in enumerate(texts):
        if not flagged[i]:
            low = text.lower()
            flagged[i] = any(h in low for h in HINTS) or "AKIA" in text
    return flagged.tolist()


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, redact: str | None = None) -> DataFrame:
    """Per row: the id column and `spans` array<struct<kind,start,end>>; with `redact` also the text with all spans replaced."""
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            texts = strings(part.column(1))
            found = [scan(t, min_cost) if f else [] for t, f in zip(texts, _may_match(texts, part.column(1)), strict=True)]
            columns = [part.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], pa.list_(span))]
            names = ["id", "spans"]
            if redact is not None:
                columns.append(pa.array([replace(t, s, redact) for t, s in zip(texts, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>" + (", redacted string" if redact is not None else "")
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(df: DataFrame, mark: str = "[secret]", min_cost: float = MIN_COST, text_col: str = "text") -> DataFrame:
    """All rows and columns of `df`, with the secrets in its texts replaced; null texts stay null."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            column = part.column(at)
            texts = column.to_pylist()
            some = _may_match([t or "" for t in texts], column)
            if any(some):
                column = pa.array([replace(t, scan(t, min_cost), mark) if f and t else t for t, f in zip(texts, some, strict=True)], column.type)
                part = part.set_column(at, part.schema.field(at), column)
            yield part

    return df.mapInArrow(run, df.schema)


def replace(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover (touching or overlapping ones together) replaced by the mark."""
    if not spans:
        return text
    out, at, stop = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a > stop:
            out += [text[at:a], mark] if stop < 0 else [text[stop:a], mark]
            at = a
        stop = max(stop, b)
    return "".join([*out, text[stop:]])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
