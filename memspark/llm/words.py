"""Words of a text as bytes. Both rules fold A-Z alone and leave every other character as it is."""

from __future__ import annotations

#: Lower-cases A-Z.
UPPER_TO_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Lower-cases A-Z; splitting then goes at blanks 0x20 and 0x09 to 0x0D.
FOLD = UPPER_TO_LOWER
#: The same, and every ASCII byte that is no letter or digit becomes a blank.
FOLD_ALPHANUMERIC = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def alphanumeric_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD_ALPHANUMERIC).split()
