"""Secret scans: fixed patterns, and strings that stay incompressible next to their surroundings.

The base kinds are patterns.  The method's own kind, ``novel``, takes runs of token characters with a letter and a digit that
stand near a sensitive word.  Each is compressed by zstandard primed with a dictionary of common identifiers and the text around
it; the bytes it adds, divided by its length, are its novelty.  A string made of known identifiers, or used again nearby, adds
little; a random one adds its whole length, or what its alphabet needs once it is long enough for zstandard to code its
characters.  So a string is held against a random one of its alphabet and length: strings of ``min_novelty`` of that or more that
overlap no base span are reported.  A string whose letters fall into word-like pieces (long runs of one case, with vowels like
those of words and without long clusters of consonants) is a name: its pieces count as one symbol each.  UUIDs and the paths of
URLs name things as well and are no candidates.  A sensitive word may stand on a line before; between the lines of an armoured block that
its header names sensitive every string is near one.

Defined results: a null text counts as empty and has no spans; positions are code points, the end is exclusive; spans are ordered
by start, then kind as listed in ``KINDS``; repeated rows are scanned each by itself; other columns are ignored.  The work is one
pass over the rows without a shuffle; nothing is kept across rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.texts import LOWER, raw_bytes, slices

KINDS = ("assign", "access", "hex", "novel")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|salt|cert", re.ASCII | re.IGNORECASE)

ARMOUR = re.compile(r"-----BEGIN ([^\n-]*)-----(.*?)(?:-----|\Z)", re.DOTALL)

#: Alphabets of encoded secrets, smaller ones first; the last has all token characters.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = tuple(
    (x, frozenset(x))
    for x in (_DIGITS + "ABCDEF", _DIGITS + "abcdef", _UPPER + "234567", _LOWER + "234567", _UPPER + _DIGITS, _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "+/_=.-")
)

#: Identifiers and words that code and configuration are full of.
IDENTIFIERS = (
    "access_token refresh_token client_id client_secret api_key api_secret private_key public_key secret_key session_id user_id "
    "username password passphrase authorization bearer basic credential credentials certificate signature algorithm expires_in "
    "created_at updated_at timestamp version config configuration settings environment production staging development localhost "
    "http https www com org net index html json yaml xml application content-type encoding utf-8 charset length request response "
    "header headers cookie callback function return import export const static public class self this null none true false "
    "string integer number boolean object array list map value default example sample test placeholder changeme your_token_here "
    "your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


@dataclass(frozen=True)
class Novelty:
    """``min_novelty`` is a share of what a random string of the same alphabet and length adds; ``around`` is the number of characters
    on either side that prime the dictionary, ``near`` how far before a candidate a sensitive word may stand, over line ends too."""

    min_length: int = 16
    min_novelty: float = 0.85
    around: int = 2000
    near: int = 48
    identifiers: str = IDENTIFIERS


UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLUSTER = re.compile(r"[^aeiouy]{4}", re.IGNORECASE)
VOWEL = re.compile(r"[aeiouy]", re.IGNORECASE)
#: Bounds of what counts as word-like: letters a piece, share of vowels.
PIECE_LENGTH, VOWEL_SHARE = 4.0, 0.31


def word_pieces(candidate: str) -> list[str]:
    """The pieces of a name made of words; none for other strings.  Random letters have fewer vowels, a quarter, and short runs of one case."""
    pieces = PIECE.findall(candidate)
    letters = sum(map(len, pieces))
    if not pieces or letters < PIECE_LENGTH * len(pieces) or len(VOWEL.findall(candidate)) < VOWEL_SHARE * letters or any(CLUSTER.search(p) for p in pieces):
        return []
    return [p for p in pieces if len(p) > 2]


def novelty(candidate: str, before: str, after: str, identifiers: str) -> float:
    """Bytes that ``candidate`` adds to a frame primed with identifiers and its surroundings, per byte."""
    primed = zstandard.ZstdCompressionDict(f"{identifiers} {after} {before}".encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = candidate.encode("utf-8", "replace")
    return (len(compressor.compress(data)) - len(compressor.compress(b""))) / len(data)


@lru_cache(maxsize=4096)
def random_novelty(alphabet: str, length: int, identifiers: str) -> float:
    """Novelty of a random string of an alphabet: 1 for short ones, towards the alphabet's bits for long ones."""
    return min(1.0, novelty("".join(random.Random(f"{alphabet}{length}").choices(alphabet, k=length)), "", "", identifiers))


def least_novelty(candidate: str, options: Novelty) -> float:
    """The novelty from which a candidate counts as random; from 4,096 characters on a random string's hardly changes."""
    own = set(candidate.rstrip("="))
    alphabet = next(x for x, every in ALPHABETS if own <= every)
    return options.min_novelty * random_novelty(alphabet, min(len(candidate), 4096), options.identifiers)


def base_spans(text: str, assign: bool = True, access: bool = True, hexadecimal: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the base kinds; the flags leave out kinds that are known not to occur."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED] if assign else []
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS] if access else []
    return spans + ([("hex", *m.span()) for m in HEX.finditer(text)] if hexadecimal else [])


def novel_spans(text: str, base: list[tuple[str, int, int]], options: Novelty) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that overlap no base span."""
    found = []
    armoured = [m.span(2) for m in ARMOUR.finditer(text) if SENSITIVE.search(m[1])] if "-----BEGIN " in text else []
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]{%d,}" % options.min_length, text):
        start, end = m.span()
        end -= len(m[0]) - len(m[0].rstrip("."))
        candidate = text[start:end]
        if len(candidate) < options.min_length or not re.search("[0-9]", candidate) or not re.search("[A-Za-z]", candidate):
            continue
        near = SENSITIVE.search(text, max(0, start - options.near), start) or any(s <= start and end <= e for s, e in armoured)
        if not near or any(s < end and start < e for _, s, e in base):
            continue
        if UUID.fullmatch(candidate) or (candidate.startswith("//") and text[start - 1 : start] == ":"):
            continue
        pieces = word_pieces(candidate)
        # what is left when every piece is one symbol; zstandard codes no matches in strings this short
        left = (len(candidate) - sum(map(len, pieces)) + len(pieces)) / len(candidate)
        if left < options.min_novelty:
            continue
        if novelty(candidate, text[max(0, start - options.around) : start], text[end : end + options.around], options.identifiers) >= least_novelty(candidate, options):
            found.append(("novel", start, end))
    return found


def long_runs(inside: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """For each text whether it may have ``least`` bytes in a row that are ``inside``."""
    outside = np.concatenate([[-1], np.flatnonzero(~inside), [len(inside)]])
    long = np.flatnonzero(np.diff(outside) > least)
    edges = np.zeros(len(bounds), np.int64)
    np.add.at(edges, np.searchsorted(bounds, outside[long] + 1, side="right") - 1, 1)
    np.add.at(edges, np.minimum(np.searchsorted(bounds, outside[long + 1], side="left"), len(bounds) - 1), -1)
    return np.cumsum(edges)[:-1] > 0


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", options: Novelty = Novelty()) -> DataFrame:
    """(id, spans) per row, where spans is an array of (kind, start, end)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(256)
        digit, letter = (every >= 48) & (every <= 57), ((LOWER >= 97) & (LOWER <= 122))
        hexadecimal = digit | ((every >= 97) & (every <= 102))
        token = digit | letter | np.isin(every, list(b"+/_=.-"))
        for batch in batches:
            data, bounds = raw_bytes(batch.column(1))
            for at, to in slices(bounds):
                part, limits = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
                raw, low = part.tobytes(), LOWER[part].tobytes()
                may_hex, may_token = (long_runs(c[part], limits, n) for c, n in ((hexadecimal, MIN_HEX), (token, options.min_length)))
                out: list[list[dict]] = []
                for d in range(to - at):
                    begin, end = int(limits[d]), int(limits[d + 1])
                    assign = any(low.find(hint, begin, end) >= 0 for hint in ASSIGN_HINTS)
                    access = raw.find(b"AKIA", begin, end) >= 0
                    spans: list[tuple[str, int, int]] = []
                    if assign or access or may_hex[d] or may_token[d]:
                        string = raw[begin:end].decode("utf-8", "replace")
                        spans = base_spans(string, assign, access, bool(may_hex[d]))
                        if may_token[d]:
                            spans += novel_spans(string, spans, options)
                    spans.sort(key=lambda s: (s[1], order[s[0]]))
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(out, kind)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
