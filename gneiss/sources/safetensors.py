"""Headers of safetensors containers: strict parsing, byte regions, and writing."""

from __future__ import annotations

import json
import struct

from gneiss.functions.dtypes import BITS

MOST_HEADER = 100_000_000


class Refused(ValueError):
    """Bytes that aren't what they should be; the message is a short reason."""


def unique_pairs(pairs: list[tuple[str, object]]) -> dict:
    """An object whose keys are all different."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("duplicate-key")
    return out


def strict_json(text: str | bytes) -> object:
    """One JSON value: no repeated keys, no NaN, no lone surrogates, nothing after it."""

    def never(_: str) -> None:
        raise Refused("number")

    try:
        value = json.loads(text, object_pairs_hook=unique_pairs, parse_constant=never)
        json.dumps(value, ensure_ascii=False).encode()
    except (UnicodeError, json.JSONDecodeError, RecursionError) as e:
        raise Refused("json") from e
    return value


def parse_header(content: bytes, size: int | None = None) -> tuple[int, list[dict]]:
    """Where the data begin, and the tensors (name, dtype, shape, offset into the file, length) in the order of their data.
    ``content`` may be the file's beginning, if ``size`` says how long the file is."""
    size = len(content) if size is None else size
    if size < 10:
        raise Refused("short")
    (n,) = struct.unpack_from("<Q", content)
    if not 2 <= n <= MOST_HEADER or 8 + n > size:
        raise Refused("header-length")
    raw = content[8 : 8 + n]
    if not raw.startswith(b"{"):
        raise Refused("header-start")
    try:
        header = strict_json(raw.decode())
    except UnicodeDecodeError as e:
        raise Refused("utf-8") from e
    if not isinstance(header, dict):
        raise Refused("header")
    tensors = []
    for name, t in header.items():
        if name == "__metadata__":
            if not isinstance(t, dict) or not all(isinstance(v, str) for v in t.values()):
                raise Refused("metadata")
            continue
        if not isinstance(t, dict) or set(t) != {"dtype", "shape", "data_offsets"}:
            raise Refused("fields")
        shape, span, bits = t["shape"], t["data_offsets"], BITS.get(t["dtype"]) if isinstance(t["dtype"], str) else None
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 64
        if bits is None:
            raise Refused("dtype")
        if not isinstance(shape, list) or not all(map(whole, shape)) or not isinstance(span, list) or len(span) != 2 or not all(map(whole, span)):
            raise Refused("numbers")
        elements = 1
        for d in shape:
            elements *= d
        if elements * bits % 8 or span[1] - span[0] != elements * bits // 8:
            raise Refused("extent")
        tensors.append({"name": name, "dtype": t["dtype"], "shape": shape, "offset": span[0], "length": span[1] - span[0]})
    tensors.sort(key=lambda t: (t["offset"], t["length"], t["name"]))
    at = 0
    for t in tensors:
        if t["offset"] != at:
            raise Refused("coverage")
        at += t["length"]
        t["offset"] += 8 + n
    if 8 + n + at != size:
        raise Refused("coverage")
    return 8 + n, tensors


def write_header(tensors: list[dict], metadata: dict[str, str] | None = None) -> bytes:
    """The header for tensors (name, dtype, shape, length) in this order, padded with spaces to a multiple of 8."""
    header: dict[str, object] = {} if metadata is None else {"__metadata__": metadata}
    at = 0
    for t in tensors:
        header[t["name"]] = {"dtype": t["dtype"], "shape": list(t["shape"]), "data_offsets": [at, at + t["length"]]}
        at += t["length"]
    raw = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
    raw += b" " * (-len(raw) % 8)
    return struct.pack("<Q", len(raw)) + raw
