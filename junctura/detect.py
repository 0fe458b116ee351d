"""What kind of input a path is, by content."""

from __future__ import annotations

import os
import re
import warnings

GZIP = b"\x1f\x8b"


def magic(path: str, n: int) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read(n)
    except OSError:
        return b""


def is_alignment_file(path: str) -> bool:
    head = magic(path, 4)
    return head[:2] == GZIP or head == b"CRAM" or head[:1] == b"@"


def is_bed_file(path: str) -> bool:
    """False only for a text whose first meaningful line names an existing path."""
    if magic(path, 2) == GZIP or not os.path.isfile(path):
        return True
    with open(path, errors="replace") as f:
        for line in map(str.strip, f):
            if not line or line[0] == "#" or line.startswith("track"):
                continue
            cols = line.split()
            if len(cols) >= 3 and all(re.fullmatch(r"[0-9]+", c) for c in cols[1:3]):
                return True
            return not os.path.exists(line)
    return True


def read_path_list(path: str) -> list[str]:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no list file {path}")
    with open(path) as f:
        found = [x.strip() for x in f if x.strip()]
    for x in found:
        if not os.path.exists(x):
            raise FileNotFoundError(f"{path} names {x}, which does not exist")
    return found


def resolve_inputs(path: str, kind: str, is_list: bool = False) -> list[str]:
    """kind: "bam" or "bed". A list that is not declared as one is accepted with a warning."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no input {path}")
    if not is_list and (is_alignment_file(path) if kind == "bam" else is_bed_file(path)):
        return [path]
    if not is_list:
        warnings.warn(f"{path} was taken for a list of paths; declare it with --{kind}_list", DeprecationWarning, stacklevel=2)
    return read_path_list(path)
