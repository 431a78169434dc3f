"""Secrets in whole texts: assignments, access keys and hexadecimal runs by pattern, keys and signed tokens by structure.

Three fixed patterns find assignments, access keys and long hexadecimal runs.
Besides, runs of base64 or hexadecimal digits, over line breaks where there are
any, are decoded and reported only if what they hold has the structure of a
secret:

* ``key``: a private key.  Its nested lengths must fill each other exactly: RSA
  and DSA integers, elliptic-curve keys, PKCS #8, encrypted or not, around a key
  of its own kind, the strings of an OpenSSH file, the numbers of an OpenPGP
  secret-key packet, or base64 around a PEM text with one of these.  Public
  keys, certificates and other structures of the same encoding are not reported.
* ``signed``: a token of three or five base64url parts whose header is a JSON
  object with ``alg``, and whose signature has the length that ``alg`` asks for,
  or whose header names an encryption and whose parts are all there.

One Arrow scan for each pattern over a batch tells which texts can hold a match;
only these are searched in Python.  Nothing is shuffled.

Defined results: null and empty texts hold nothing; spans count code points and
end before their second number; spans of different kinds may overlap; spans of
one kind don't; repeated rows are searched alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "signed")

# The patterns and lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Where an encoded key may start: base64 of a sequence, of a PEM text, of an OpenSSH file and of OpenPGP's packets 5.
START = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/]))(?:M[A-Za-z0-9+/]|LS0t|b3Bl|l[A-Za-z0-9+/]|x[QR])[A-Za-z0-9+/]{14,}")
NEXT_LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*([A-Za-z0-9+/]+={0,2})")
HEX_START = re.compile(r"(?:(?<=0x)|(?<![0-9A-Fa-f]))(?:30|6f|6F)[0-9A-Fa-f]{70,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?")
#: What a text must hold for each search, in the syntax of Arrow's scans, which know no look-behind.
NEEDED = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "key": r"(M[A-Za-z0-9+/]|LS0t|b3Bl|l[A-Za-z0-9+/]|x[QR])[A-Za-z0-9+/]{14}|(30|6f|6F)[0-9A-Fa-f]{70}",
    "signed": r"e[w-z0-9_-][A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*\.",
}
#: Bytes of a key at most; RSA with 16,384 bits has less than a tenth.
KEY_BYTES = 1 << 17

# Published identifiers and sizes of formats.
SEQUENCE, INTEGER, BITS, OCTETS, OID = 0x30, 0x02, 0x03, 0x04, 0x06
RSA_OID = bytes.fromhex("2a864886f70d010101")
ENCRYPTION_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH_MAGIC = b"openssh-key-v1\0"
PGP_NUMBERS = {1: 2, 2: 2, 3: 2, 16: 3, 17: 4}
PGP_CURVES = (18, 19, 22)
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "Ed25519": (64,)}
LEAST_RSA_SIGNATURE = 64

Part = tuple[int, int, int]


def part_at(data: bytes, at: int, end: int) -> Part | None:
    """Tag, start and stop of the encoded part at ``at``, if its length fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    start = at + 2
    if size >= 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or start + more > end:
            return None
        size = int.from_bytes(data[start : start + more])
        start += more
    return (tag, start, start + size) if start + size <= end else None


def parts(data: bytes, at: int, end: int) -> list[Part] | None:
    """The parts that fill ``data[at:end]`` exactly."""
    out = []
    while at < end:
        found = part_at(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def sequence(data: bytes, whole: Part | None) -> list[Part]:
    return (parts(data, whole[1], whole[2]) or []) if whole and whole[0] == SEQUENCE else []


def encoded_key(data: bytes) -> bool:
    """Whether ``data`` is one private key in DER."""
    whole = part_at(data, 0, len(data))
    return whole is not None and whole[2] == len(data) and _is_key(data, sequence(data, whole))


def _is_key(data: bytes, inner: list[Part]) -> bool:
    tags = [t for t, *_ in inner]
    value = lambda k: data[inner[k][1] : inner[k][2]]
    if len(tags) < 2:
        return False
    if set(tags) == {INTEGER}:
        # RSA: version, modulus, exponents, primes and what follows from them; DSA: version, p, q, g, y, x
        return len(tags) in (6, 9) and value(0) == b"\0" and all(stop > start for _, start, stop in inner) and len(value(1)) > 32
    if tags[:2] == [INTEGER, OCTETS] and value(0) == b"\1":
        return len(value(1)) >= 16 and all(_describes_curve(data, p) for p in inner[2:])
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and value(0) in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        algorithm = sequence(data, inner[1])
        if not algorithm or algorithm[0][0] != OID:
            return False
        held = part_at(data, inner[2][1], inner[2][2])
        if held is None or held[2] != inner[2][2]:
            return False
        if data[algorithm[0][1] : algorithm[0][2]] == RSA_OID:
            return _is_key(data, sequence(data, held))
        return held[0] in (OCTETS, INTEGER) or _is_key(data, sequence(data, held))
    if tags == [SEQUENCE, OCTETS]:
        algorithm = sequence(data, inner[0])
        return len(algorithm) == 2 and algorithm[0][0] == OID and data[algorithm[0][1] : algorithm[0][2]].startswith(ENCRYPTION_OIDS) and len(value(1)) >= 32
    return False


def _describes_curve(data: bytes, part: Part) -> bool:
    """Optional parts of elliptic-curve keys: [0] holds the curve, [1] the public point."""
    held = part_at(data, part[1], part[2])
    return held is not None and held[2] == part[2] and (part[0], held[0]) in ((0xA0, OID), (0xA0, SEQUENCE), (0xA1, BITS))


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that ``data`` begins with, or 0."""
    if not data.startswith(OPENSSH_MAGIC):
        return 0
    at = len(OPENSSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = string(), string(), string()
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not cipher or not kdf or options is None or not 1 <= keys <= 16:
        return 0
    public = [string() for _ in range(keys)]
    if any(not p or int.from_bytes(p[:4]) + 4 > len(p) for p in public) or not string():
        return 0
    return at


def pgp_secret(data: bytes) -> bool:
    """Whether ``data`` begins with a whole OpenPGP secret-key packet."""
    if len(data) < 12:
        return False
    if data[0] == 0xC5:
        size, at = data[1], 2
        if 192 <= size < 224:
            size, at = ((size - 192) << 8) + data[2] + 192, 3
        elif size == 255:
            size, at = int.from_bytes(data[2:6]), 6
    elif data[0] in (0x94, 0x95, 0x96):
        width = 1 << (data[0] & 3)
        size, at = int.from_bytes(data[1 : 1 + width]), 1 + width
    else:
        return False
    end = at + size
    if end > len(data) or size < 12 or data[at] != 4:
        return False
    algorithm, at = data[at + 5], at + 6
    if algorithm in PGP_CURVES:
        at, numbers = at + 1 + data[at], 1
    else:
        numbers = PGP_NUMBERS.get(algorithm, 0)
    if not numbers:
        return False
    for _ in range(numbers):
        bits = int.from_bytes(data[at : at + 2])
        width = (bits + 7) // 8
        if not bits or at + 2 + width >= end or data[at + 2].bit_length() != (bits - 1) % 8 + 1:
            return False
        at += 2 + width
    return True


def _unbase64(chars: str) -> bytes:
    chars = chars.rstrip("=")
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return binascii.a2b_base64(chars + "=" * (-len(chars) % 4))


def _run(text: str, at: int, stop: int, chars: int) -> tuple[str, list[tuple[int, int]]]:
    """The base64 digits from ``at`` on, over line breaks, until there are ``chars``, and where the pieces are."""
    pieces, total = [(at, stop)], stop - at
    while total < chars and text[pieces[-1][1] - 1] != "=":
        found = NEXT_LINE.match(text, pieces[-1][1])
        if not found:
            break
        pieces.append(found.span(1))
        total += found.end(1) - found.start(1)
    return "".join(text[a:b] for a, b in pieces), pieces


def _end(text: str, pieces: list[tuple[int, int]], size: int) -> int:
    """Where the digits of ``size`` bytes end, with what fills up their last four."""
    left = (size * 4 + 2) // 3
    for start, stop in pieces:
        if left <= stop - start:
            stop = start + left
            while left % 4 and text[stop : stop + 1] == "=":
                stop, left = stop + 1, left + 1
            return stop
        left -= stop - start
    return pieces[-1][1]


def keys(text: str, inside: bool = False) -> list[tuple[int, int]]:
    """Spans of encoded private keys; ``inside``: of a text that was itself encoded."""
    out, done = [], 0
    for found in START.finditer(text):
        at, stop = found.span()
        if at < done:
            continue
        head = _unbase64(text[at : at + 16])
        size, pieces = 0, []
        if head[0] == SEQUENCE:
            # the length alone says how much is to be decoded
            more = head[1] & 0x7F if head[1] >= 0x80 else 0
            size = 2 + more + (int.from_bytes(head[2 : 2 + more]) if more else head[1])
            if more > 4 or not 37 <= size <= KEY_BYTES:
                continue
            chars, pieces = _run(text, at, stop, (size * 4 + 2) // 3)
            data = _unbase64(chars)[:size]
            size = size if len(data) == size and encoded_key(data) else 0
        elif head.startswith((b"---", b"ope", b"\x94", b"\x95", b"\x96", b"\xc5")):
            chars, pieces = _run(text, at, stop, KEY_BYTES * 4 // 3)
            data = _unbase64(chars)
            if head.startswith(b"ope"):
                size = openssh_size(data)
            elif head.startswith(b"---"):
                size = len(data) if not inside and keys(data.decode("latin-1"), True) else 0
            else:
                size = len(data) if pgp_secret(data) else 0
        if size:
            done = _end(text, pieces, size)
            out.append((at, done))
    for found in HEX_START.finditer(text):
        digits = found.group()
        data = bytes.fromhex(digits[: len(digits) - len(digits) % 2])
        whole = part_at(data, 0, len(data))
        size = whole[2] if whole and encoded_key(data[: whole[2]]) else openssh_size(data)
        if size:
            out.append((found.start(), found.start() + 2 * size))
    return out


def _part(chars: str) -> bytes | None:
    if len(chars) % 4 == 1:
        return None
    return binascii.a2b_base64(chars.translate({45: "+", 95: "/"}) + "=" * (-len(chars) % 4))


def signed(text: str) -> list[tuple[int, int]]:
    """Spans of signed or encrypted tokens."""
    out, at = [], 0
    while found := TOKEN.search(text, at):
        size = _token_size(found.group().split("."))
        at = found.start() + (size or 1)
        if size:
            out.append((found.start(), at))
    return out


def _token_size(pieces: list[str]) -> int:
    """Characters of the token that the pieces begin with, or 0."""
    found = [_part(p) for p in pieces]
    if found[0] is None:
        return 0
    try:
        header = json.loads(found[0])
    except (ValueError, RecursionError):
        return 0
    algorithm = header.get("alg") if isinstance(header, dict) else None
    if not isinstance(algorithm, str):
        return 0
    if isinstance(header.get("enc"), str):
        # key, vector, text and tag; agreed keys are not sent
        whole = len(pieces) == 5 and None not in found and all(found[2:])
        return sum(map(len, pieces)) + 4 if whole else 0
    payload, signature = found[1:3]
    if payload is None or signature is None:
        return 0
    if algorithm in SIGNATURE_BYTES:
        fits = len(signature) in SIGNATURE_BYTES[algorithm]
    elif algorithm == "none":
        fits = not signature and bool(payload)
    else:
        fits = len(signature) >= LEAST_RSA_SIGNATURE
    return sum(map(len, pieces[:3])) + 2 if fits else 0


SEARCHES: dict[str, Callable[[str], list[tuple[int, int]]]] = {
    "assign": lambda t: [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= ASSIGN_CHARS],
    "access": lambda t: [m.span() for m in ACCESS.finditer(t) if len(m[0]) >= ACCESS_CHARS],
    "hex": lambda t: [m.span() for m in HEX.finditer(t)],
    "key": keys,
    "signed": signed,
}


def spans_of(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int]]:
    """Start, number of the kind and end, in this order."""
    return sorted((start, KINDS.index(k), stop) for k in kinds for start, stop in SEARCHES[k](text))


SPANS = "array<struct<kind:string,start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans, by start and kind, of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1), [[] for _ in range(batch.num_rows)]
            can = {k: pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(False) for k, p in NEEDED.items()}
            for k in sum(can.values()).nonzero()[0]:
                found = spans_of(texts[int(k)].as_py(), tuple(name for name in KINDS if can[name][k]))
                rows[k] = [{"kind": KINDS[i], "start": start, "stop": stop} for start, i, stop in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans, all spans as text and how many the structure confirmed."""
    number = lambda *kinds: F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(number(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), number("key", "signed").alias("n_confirmed"),
    )
