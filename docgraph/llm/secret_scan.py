"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what has no pattern.

A candidate is a long token near a word that announces a secret. Its marginal compressed size is what
zstandard needs for the text around it with the candidate, less what it needs without it, where the
compressor is primed with the identifiers that are in most documents of the corpus, with common ones of code, and with the text
around the candidate, without other copies of the candidate. Words, paths and names cost next to nothing; keys and hashes cost
what their letters hold, however often they are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices
from .spans import Span, Taken, digest, written

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

#: A candidate has this many characters, two character kinds, and up to REACH before it one of the words or another secret; or
#: only separators lie between it and a candidate with such a context, or it stands in the block of a private key.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
_SENSITIVE = re.compile(
    r"passw|passwd|pwd|secret|token|api[_-]?key|apikey|credential|private[_ -]?key|auth|bearer|signature|access[_ -]?key|encryption", re.I | re.A
)
REACH, AROUND = 48, 2048
_KEY_BEGIN, _KEY_END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----"), "-----END"
_KEY_TAIL = re.compile(r"(?:\s|\\[nr])*+([A-Za-z0-9+/=]{1,15})(?:\s|\\[nr])*-----END")
_SEPARATORS = re.compile(r"(?:\\[nrt]|[^A-Za-z0-9\\])*+")
#: A run of half the candidate's characters, and of this many at least and at most, is a copy of it.
LEAST_COPY, MOST_COPY = 12, 64
#: Reported from this many marginal bytes for each 10 characters. A random base64 letter holds 7.5 of 10.
LEAST_PER_10 = 6.0
#: Bytes of the corpus's own words in the dictionary, how long they may be, and in how many documents they have to be.
DICTIONARY_BYTES, LONGEST_WORD, LEAST_DOCUMENTS = 16384, 24, 3
#: Identifiers that any code may hold.
IDENTIFIERS = (
    b"username password passwd user_password secret client_secret api_key apikey access_key secret_access_key token auth_token "
    b"access_token refresh_token bearer authorization credentials private_key public_key session_id cookie signature encryption "
    b"example placeholder changeme your-api-key-here xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    b"config settings environment process.env os.environ getenv return function const static public class import from export default "
    b"http:// https:// www. .com .org .net localhost 127.0.0.1 application/json text/html content-type request response "
)


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then kind as in KINDS."""
    found = []
    small = text.lower()
    if any(w in small for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _without_copies(text: str, low: int, high: int, first: int, last: int, own: str) -> str:
    """text[low:high] without the runs that ``own`` has too; ``first`` and ``last`` bound the search for copies that an end cuts."""
    width = max(LEAST_COPY, min(MOST_COPY, len(own) // 2))
    first, last = max(first, low - width), min(last, high + width)
    places: dict[str, list[int]] = {}
    for i in range(first, last - width + 1):
        places.setdefault(text[i : i + width], []).append(i)
    shared = sorted({i for k in range(len(own) - width + 1) for i in places.pop(own[k : k + width], ())})
    out, at = [], low
    for i in shared:
        if i > at:
            out.append(text[at : min(i, high)])
        at = max(at, i + width)
    return "".join(out) + text[at:high]


def dictionary(docs: DataFrame, most_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The words that identifiers and texts of most documents are made of, as they are and with a capital, up to ``most_bytes``; the most
    common last, where they cost least.

    A word is a run of small letters, so no key is learnt as a name.
    """
    parts = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rf"[A-Z]?[a-z]{{3,{LONGEST_WORD - 1}}}(?![a-z0-9])"), F.lit(0)), F.lower))
    counted = docs.select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    common, size = [], 0
    for r in counted.orderBy(F.desc("n"), "word").limit(most_bytes // 8).collect():  # each takes eight bytes or more
        size += 2 * len(r["word"]) + 2
        if size > most_bytes:
            break
        common.append(f"{r['word']} {r['word'].capitalize()}")
    return " ".join(reversed(common)).encode()


def marginal_bytes(text: str, start: int, end: int, known: bytes = b"") -> int:
    """What the span adds to the compressed size of the text just before it, where no other copy of the span is known."""
    own = text[start:end]
    before = _without_copies(text, max(0, start - AROUND), start, 0, start, own)
    after = _without_copies(text, end, min(len(text), end + AROUND), end, len(text), own)
    primer = IDENTIFIERS + known + b" " + (after + " " + before).encode()
    coder = zstandard.ZstdCompressor(
        level=19, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False, write_dict_id=False,
    )
    lead = before[-64:].encode()
    return len(coder.compress(lead + own.encode())) - len(coder.compress(lead))


def _key_blocks(text: str) -> list[tuple[int, int]]:
    """The places between the begin and end lines of private keys."""
    found, at = [], 0
    while begin := _KEY_BEGIN.search(text, at):
        at = text.find(_KEY_END, begin.end())
        if at < 0:
            break
        found.append((begin.end(), at))
    return found


def novel_spans(text: str, base: list[Span], known: bytes = b"") -> list[Span]:
    """Candidates in a sensitive context that do not compress after the dictionary ``known``, and that no base span overlaps."""
    found: list[Span] = []
    if not _SENSITIVE.search(text):
        return found
    taken, blocks, patterns = Taken(base), _key_blocks(text), sorted((s for s in base if s[0] != "hex"), key=lambda s: s[2])
    block = pattern = 0
    adjacent = secret = -1  # the ends of the last candidate with a sensitive context, and of the last secret
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while block < len(blocks) and blocks[block][1] <= start:
            block += 1
        while pattern < len(patterns) and patterns[pattern][2] <= start:
            secret = max(secret, patterns[pattern][2])
            pattern += 1
        kinds = (any(c.isdigit() for c in m[0])) + (any(c.isupper() for c in m[0])) + (any(c.islower() for c in m[0]))
        if kinds < 2:
            continue
        in_block = block < len(blocks) and blocks[block][0] <= start
        carried = 0 <= secret >= start - REACH or adjacent >= 0 and _SEPARATORS.fullmatch(text, adjacent, start) is not None
        if not in_block and not carried and not _SENSITIVE.search(text, max(0, start - REACH), start):
            continue
        adjacent = end
        if taken.meets(start, end):
            secret = end
            continue
        if 10 * marginal_bytes(text, start, end, known) >= LEAST_PER_10 * (end - start):
            found.append(("novel", start, end))
            secret = end
            tail = _KEY_TAIL.match(text, end) if in_block else None
            if tail and not taken.meets(*tail.span(1)):
                found.append(("novel", *tail.span(1)))
    return found


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                columns: list[list] = [[], [], [], [], []]
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    both = base + novel_spans(text or "", base, shared.value)
                    for k, kind in enumerate(KINDS):
                        columns[k].append(sum(s[0] == kind for s in base))
                    columns[3].append(digest(base))
                    columns[4].append(written(sorted(both, key=lambda s: s[1])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return scan


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of (doc_id, text, ...).

    ``spans`` lists all spans as kind:start:end, comma-joined, by start, the kind ``novel`` being those found by
    compression; base_sha256 is the digest of the list of pattern spans alone. Null text counts as empty, and an empty text
    has no spans. A null doc_id is passed through, rows that repeat a doc_id each give a row, other columns are
    ignored, and an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    return docs.mapInArrow(
        _scanner(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of the text replaced by <SECRET>; null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [None if text is None else _masked(text, shared.value) for text in batch.column("text").to_pylist()]
                k = batch.schema.get_field_index("text")
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, known: bytes) -> str:
    out, at = [], 0
    base = base_spans(text)
    for _, start, end in sorted(base + novel_spans(text, base, known), key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], "<SECRET>"]
        at = max(at, end)
    return "".join(out) + text[at:]
