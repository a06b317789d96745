"""Labelled credentials for grammar inference, made by rule from publicly documented key formats.

Provenance: every value is drawn at random here, with a fixed seed, from the format's public description (literal parts,
alphabets and lengths). None is or was a live key, and none comes from the corpus that is scanned.
"""

from __future__ import annotations

import random
import string

ALNUM = string.ascii_letters + string.digits
URL = ALNUM + "_-"
#: By format, its parts in order, each a literal or (alphabet, least length, greatest length).
FORMATS: dict[str, list] = {
    "aws secret": [(ALNUM + "/+", 40, 40)],
    "github": ["ghp_", (ALNUM, 36, 36)],
    "github oauth": ["gho_", (ALNUM, 36, 36)],
    "gitlab": ["glpat-", (URL, 20, 20)],
    "google": ["AIza", (URL, 35, 35)],
    "jwt": ["eyJ", (URL, 17, 40), ".eyJ", (URL, 20, 60), ".", (URL, 43, 43)],
    "npm": ["npm_", (ALNUM, 36, 36)],
    "openai": ["sk-", (ALNUM, 48, 48)],
    "slack": ["xoxb-", (string.digits, 11, 13), "-", (string.digits, 11, 13), "-", (ALNUM, 24, 24)],
    "stripe": ["sk_live_", (ALNUM, 24, 24)],
    "upper hex": [("0123456789ABCDEF", 32, 64)],
}


def make(name: str, rnd: random.Random) -> str:
    return "".join(p if isinstance(p, str) else "".join(rnd.choices(p[0], k=rnd.randint(p[1], p[2]))) for p in FORMATS[name])


def labelled(per_format: int = 200, seed: int = 20) -> list[tuple[str, str]]:
    """(format, value) pairs."""
    rnd = random.Random(seed)
    return [(name, make(name, rnd)) for name in sorted(FORMATS) for _ in range(per_format)]
