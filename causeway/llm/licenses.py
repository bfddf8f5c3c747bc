"""Operator 8, license scans: conditional compression against templates, confirmed by exact wording.

Blocks are the surroundings of license words: as many words to either side as the longest template of a class needs (short notices, full texts), merged
where they meet, across blank lines (notices have paragraphs), and cut into overlapping blocks of bounded length. Each block is compressed by zstandard alone and with every
template as a raw dictionary; templates are ranked by how much smaller they make the block. In that order, all that make it smaller are aligned word by word: places
where enough of a template's word pairs lie in one diagonal band are compared, and each whose differing words are at most ``slack`` of the template's,
none of them decisive (a number, a word of a license's name, a negation), is an alignment with a span of its own. Of overlapping alignments the one with
the most words explained wins (then fewer differences, then the larger reduction); all others are findings each. A bare reservation of rights counts only if
neither its paragraph nor the next one has another license, as the line of a copyright stands before its notice.

Scale: one map over the texts; texts without a license word never leave the JVM. Work is linear in the length of a text: lines are scanned once, blocks have bounded
length, and alignments are made only inside a band.

Cases: null and empty texts have no block; very long texts and lines are cut into overlapping blocks, so no notice is lost at a cut; equal notices in a text
are found each; of equally good overlapping alignments the first name in order wins; repeated rows are scanned each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, table, text_batches
from causeway.llm.license_texts import TITLES, templates as known_templates

ANCHOR = r"(?i)licen[sc]|copyright|\bwarrant|redistribut|permission (?:is hereby|to use)|spdx|all rights reserved|public domain|\bcc(?:0|[ -]by)\b"
ANCHORS = re.compile(ANCHOR.removeprefix("(?i)"), re.I)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-+][A-Za-z0-9]+)*")
BLANK_LINE = re.compile(r"\n[ \t\r\x0b\x0c]*(?=\n)")
#: Words of titles that tell no licenses apart.
PLAIN = set("license licence public version general the free software open source development distribution and foundation do what you want to of".split())
NAMES = {w for title in [*TITLES, *TITLES.values()] for w in WORD.findall(title.lower())} - PLAIN
DECISIVE = re.compile(r"\d|^(?:attribution.*|sharealike|noncommercial|noderivatives|nc|nd|sa|by|not|no|agpl|gpl|lgpl|mpl|epl)$")
#: Most words of the templates of a class; the last one has the rest.
CLASSES = (40, None)
#: What is dropped beside any other license of its paragraph or the next.
WEAK = {"Proprietary"}


@dataclass(frozen=True)
class Alignment:
    start: int  # words of the block
    end: int
    license: str
    size: int  # words of the template
    gain: float
    differing: tuple[str, ...]

    def order(self) -> tuple:
        return (-(self.size - len(self.differing)), len(self.differing), -self.gain, self.license, self.start)


def decisive(word: str) -> bool:
    return word in NAMES or DECISIVE.search(word) is not None


def align(template: list[str], words: list[str]) -> tuple[int, int, tuple[str, ...]] | None:
    """(first word, behind the last word, differing words) of the template's best place in a few words: those of either that the other lacks there."""
    match = [b for b in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if b.size]
    if not match:
        return None
    out, i, j = [], 0, match[0].b
    for m in match:
        out += template[i : m.a] + words[j : m.b]
        i, j = m.a + m.size, m.b + m.size
    return match[0].b, j, tuple(out + template[i:])


class Templates:
    """The templates of one class, as zstandard dictionaries, as words, and by word pairs."""

    def __init__(self, texts: list[tuple[str, str]], slack: float, level: int = 3) -> None:
        self.slack, self.alone, self.all = slack, zstandard.ZstdCompressor(level=level, write_content_size=False), []
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for name, text in texts:
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            words = WORD.findall(text.lower())
            for i, pair in enumerate(zip(words, words[1:])):
                self.pairs[pair].append((len(self.all), i))
            self.all.append((name, words, zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=raw)))
        self.longest = max((len(w) for _, w, _ in self.all), default=0)
        self.reach = self.longest + self.room(self.longest)

    def room(self, size: int) -> int:
        """Words that may differ."""
        return int(self.slack * size)

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(size reduction, template number), best first."""
        raw = block.lower().encode()
        alone = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, i) for i, (_, _, c) in enumerate(self.all)), key=lambda x: (-x[0], x[1]))

    def confirmed(self, block: str, words: list[str]) -> list[Alignment]:
        """All alignments in a block with templates that make it smaller, in the order of the ranking."""
        diagonals: dict[int, list[int]] = defaultdict(list)
        for j, pair in enumerate(zip(words, words[1:])):
            for t, i in self.pairs.get(pair, ()):
                diagonals[t].append(j - i)
        # up to room words differ, and each breaks two pairs at most
        asked = {t: max(1, len(self.all[t][1]) - 1 - 2 * self.room(len(self.all[t][1]))) for t in diagonals}
        if not any(len(d) >= asked[t] for t, d in diagonals.items()):
            return []
        out = []
        for gain, t in self.rank(block):
            name, own, _ = self.all[t]
            if gain <= 0 or t not in diagonals or len(diagonals[t]) < asked[t]:
                continue
            room, last = self.room(len(own)), -1
            votes = Counter(diagonals[t])
            places = sorted(votes)
            for a, d in enumerate(places):
                if sum(votes[x] for x in places[a : bisect_right(places, d + room)]) < asked[t] or d + len(own) <= last:
                    continue
                begin = max(0, d - room, last)
                found = align(own, words[begin : d + len(own) + 2 * room])
                if found and len(found[2]) <= self.slack * len(own) and not any(map(decisive, found[2])):
                    last = begin + found[1]
                    out.append(Alignment(begin + found[0], last, name, len(own), gain, found[2]))
        return out


def classes(texts: dict[str, list[str]], slack: float) -> list[Templates]:
    """The templates by their number of words."""
    out: list[list[tuple[str, str]]] = [[] for _ in CLASSES]
    for name in texts:
        for text in texts[name]:
            n = len(WORD.findall(text))
            out[next(k for k, most in enumerate(CLASSES) if most is None or n <= most)].append((name, text))
    return [Templates(own, slack) for own in out if own]


def blocks(anchors: list[int], n: int, reach: int) -> Iterator[tuple[int, int]]:
    """(first word, behind the last) of the blocks around anchored words."""
    merged: list[list[int]] = []
    for at in anchors:
        low, high = max(at - reach, 0), min(at + reach + 1, n)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    for low, high in merged:
        while high - low > 3 * reach:
            yield low, low + 2 * reach
            low += reach
        yield low, high


def findings(text: str, known: list[Templates], met: dict) -> list[tuple[int, int, str, float, list[str]]]:
    """(start, end, license, gain, differing words) of a text, by start; start and end are character offsets."""
    spans = [m.span() for m in WORD.finditer(text)]
    starts = [s for s, _ in spans]
    words = [text[s:e].lower() for s, e in spans]
    anchors = sorted({max(bisect_right(starts, m.start()) - 1, 0) for m in ANCHORS.finditer(text)}) if words else []
    paragraphs = sorted({bisect_left(starts, m.end()) for m in BLANK_LINE.finditer(text)}) if anchors else []
    found: list[Alignment] = []
    for templates in known:
        for low, high in blocks(anchors, len(words), templates.reach):
            block = text[spans[low][0] : spans[high - 1][1]]
            key = (templates.longest, block)
            if key not in met:
                if len(met) > 20_000:
                    met.clear()
                met[key] = templates.confirmed(block, words[low:high])
            found += [Alignment(a.start + low, a.end + low, a.license, a.size, a.gain, a.differing) for a in met[key]]
    kept: list[Alignment] = []
    begins: list[int] = []
    for a in sorted(set(found), key=Alignment.order):
        i = bisect_left(begins, a.end)  # kept ones don't overlap, so only the last that begins before a's end can meet it
        if i == 0 or kept[i - 1].end <= a.start:
            kept.insert(i, a)
            begins.insert(i, a.start)
    strong = {p for a in kept if a.license not in WEAK for p in (bisect_right(paragraphs, a.start) - 1, *range(bisect_right(paragraphs, a.start), bisect_left(paragraphs, a.end) + 1))}
    return [(spans[a.start][0], spans[a.end - 1][1], a.license, a.gain, list(a.differing)) for a in kept if a.license not in WEAK or bisect_right(paragraphs, a.start) not in strong]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, slack: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, license, gain, differing array<string>) of every confirmed alignment."""
    text_batches(docs.sparkSession)
    texts = templates or known_templates()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = classes(texts, slack), {}
        for batch in by_bytes(batches, "text"):
            out = [(doc, *x) for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for x in findings(text, known, met)]
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["id", "start", "end", "license", "gain", "differing"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(ANCHOR))
    return rows.mapInArrow(scan, "id long, start int, end int, license string, gain double, differing array<string>").withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "license", F.round("gain", 6).alias("gain"), F.size("differing").alias("n_differing"))
