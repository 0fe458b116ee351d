"""Names of samples and of output files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: Endings of sequence files, compressed or not.
FASTA = re.compile(r"\.(?:fasta|fa|fna)(?:\.gz)?$")


def _parts(path: str) -> tuple[str | None, str]:
    """Folder (None if the path names none) and last part; both kinds of slashes separate."""
    m = re.match(r"(?s)(.*)[/\\]([^/\\]*)$", path)
    return (m[1], m[2]) if m else (None, path)


def folder_of(path: str) -> str | None:
    return _parts(path)[0]


def sample_name(path: str) -> str:
    """The last part without its last extension."""
    return re.sub(r"\.[^.]*$", "", _parts(path)[1])


def genome_name(path: str) -> str:
    """The last part without the endings of sequence files, or else without its last extension."""
    last = _parts(path)[1]
    return FASTA.sub("", last) if FASTA.search(last) else sample_name(last)


@dataclass(frozen=True)
class Target:
    """What an output option names: one file, or a folder that gets a file for each input.

    A folder that exists or an ending slash is a folder; otherwise a dot in the last part makes a file."""

    text: str

    @property
    def is_file(self) -> bool:
        return "." in _parts(self.text)[1] and not os.path.isdir(self.text)

    @property
    def folder(self) -> str | None:
        """The folder itself, or that of the file; None if it isn't named."""
        return (folder_of(self.text) if self.is_file else self.text) or None

    def files(self, inputs: list[str], suffix: str, extension: str) -> list[str]:
        """A single input goes to the file that is named; otherwise each to its own name in the folder."""
        if self.is_file and len(inputs) == 1:
            return [self.text]
        base = self.folder or ("." if self.is_file else self.text)
        return ["/".join((base, sample_name(x) + suffix + extension)) for x in inputs]


def beside(path: str, suffix: str, extension: str) -> str:
    """The path with a suffix before its extension."""
    return path.removesuffix(extension) + suffix + extension
