"""Byte alphabet and one-character token symbols.

A word is held as a string with exactly ONE character per token: token id ``i`` is the character
``chr(i + 32)``, stepping over the surrogate block. Three facts make this layout fast in Spark:

* merging a pair is one ``replace(s, 'xy', 'z')``; UTF-8 is self-synchronising, so the byte search
  inside ``replace`` can only match whole tokens, leftmost first and without overlap;
* the number of tokens is ``char_length(s)``;
* Spark compares strings by bytes, which for UTF-8 is code point order, so ordering two-character
  pairs orders them by ``(left_id, right_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPECIAL_TOKEN = "[UNK]"
SPECIAL_ID = 0
BASE_SIZE = 257  # the special token plus one token per byte value

_OFFSET = 32
_SURROGATES = (0xD800, 0xE000)
#: Ids that a character can stand for.
MAX_SYMBOLS = 0x110000 - (_SURROGATES[1] - _SURROGATES[0]) - _OFFSET


def symbol_char(token_id: int) -> str:
    """The character standing for a token id."""
    point = token_id + _OFFSET
    if point >= _SURROGATES[0]:
        point += _SURROGATES[1] - _SURROGATES[0]
    return chr(point)


def symbol_id(char: str) -> int:
    """Inverse of :func:`symbol_char`."""
    point = ord(char)
    if point >= _SURROGATES[1]:
        point -= _SURROGATES[1] - _SURROGATES[0]
    return point - _OFFSET


def byte_alphabet() -> dict[int, str]:
    """Byte value -> printable character, by the published byte-level rule.

    Bytes that are printable in Latin-1 stand for themselves; the others take the code points from
    U+0100 upward in byte order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)}


def base_tokens() -> list[str]:
    """Token strings of ids 0..256: the special token, then the alphabet by code point."""
    return [SPECIAL_TOKEN, *sorted(byte_alphabet().values())]


def one_char_per_byte(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def translation(target: dict[int, str]) -> tuple[str, str]:
    moved = {b: c for b, c in target.items() if chr(b) != c}
    return "".join(map(chr, moved)), "".join(moved.values())


def to_byte_alphabet(text: Column) -> Column:
    """Text -> its UTF-8 bytes written in the printable alphabet."""
    return F.translate(one_char_per_byte(text), *translation(byte_alphabet()))


def to_symbols(word: Column) -> Column:
    """Word -> one symbol character per UTF-8 byte, the start state of training and encoding."""
    ids = {token: token_id for token_id, token in enumerate(base_tokens())}
    return F.translate(
        one_char_per_byte(word),
        *translation({b: symbol_char(ids[c]) for b, c in byte_alphabet().items()}),
    )


def alphabet_to_bytes(token: Column) -> Column:
    """Alphabet string -> the bytes it spells (BINARY)."""
    alphabet = byte_alphabet()
    back = {c: chr(b) for b, c in alphabet.items() if chr(b) != c and b != 0}
    # translate() deletes characters mapped to NUL, so byte 0 is put in by replace().
    latin = F.translate(token, "".join(back), "".join(back.values()))
    return F.encode(F.replace(latin, F.lit(alphabet[0]), F.lit("\0")), "ISO-8859-1")


def decode_tokens(tokens: Column) -> Column:
    """Array of token strings -> text; incomplete UTF-8 becomes U+FFFD, special tokens are dropped."""
    kept = F.filter(tokens, lambda t: t != F.lit(SPECIAL_TOKEN))
    spelled = alphabet_to_bytes(F.array_join(kept, ""))
    return F.make_valid_utf8(spelled.cast("string"))


def symbols_to_ids(symbols: Column) -> Column:
    """Symbol string -> array of token ids."""
    low, high = _SURROGATES
    return F.when(F.char_length(symbols) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(
            F.split(symbols, ""),
            lambda c: F.ascii(c) - _OFFSET - F.when(F.ascii(c) >= high, high - low).otherwise(0),
        )
    )


def id_to_symbol(token_id: Column) -> Column:
    """Column form of :func:`symbol_char`."""
    low, high = _SURROGATES
    point = token_id + _OFFSET
    point = F.when(point >= low, point + (high - low)).otherwise(point)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
