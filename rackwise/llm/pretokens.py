"""Pre-tokens of the public tokenizers, found with Python's regular expressions, and encodings kept between batches."""

from __future__ import annotations

import re

import public_tokenizers
import regex

#: The alternatives of the two published pre-tokenizer patterns, with letters, numbers and white space named.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: White space as the Unicode property has it (unlike \s in Python, without \x1c-\x1f).
SPACE = r"\t-\r \x85\xa0  -     　"
#: In texts of these characters only (none of this pattern), the ranges below are all letters and numbers there are, and str.split() cuts at SPACE.
USUAL = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁔]")
LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": SPACE}
WIDE = {"L": r"\p{L}", "N": r"\p{N}", "S": SPACE}



def finders(pattern: str):
    """findall for texts of usual characters, and for any text."""
    fill = lambda names: pattern.replace("{L}", names["L"]).replace("{N}", names["N"]).replace("{S}", names["S"])
    return re.compile(fill(LATIN)).findall, regex.compile(fill(WIDE)).findall


def file_of(name: str) -> str:
    """Where a vocabulary file lies on this machine; a path is taken as it is."""
    return name if "/" in name else public_tokenizers.path(name)
