"""Plain statements of the rules and the public tokenizer package, for checking Spark results."""

from __future__ import annotations

import json
from bisect import bisect_left
from itertools import accumulate

from tokenizers import ByteLevelBPETokenizer

UNICODE_TEXTS = [
    "it's  a   test\n\n x y  z ",
    "　wide　　space  nb\u0085next\t\ttab  ",
    "٠١ x²½ Ⅷ WE'LL we'll I'm they're 中文 😀😀 a",
    "  leading and trailing   ",
    "don't!!?? (e.g.) C++ a_b __init__ 12,345.67 \r\n\r\n end",
    "naïve café €100 Ünïcödé — “quotes”   line  para",
    "aaaa aaa aa a",
    "\x00\x01 control \x7f \x1b[0m",
]


def take_bytes(rows, max_bytes):
    """(kept rows, number of rows consumed) of a byte budget over (key, text) rows.

    The row holding the last byte of the budget is found from cumulative sizes; its cut steps back over
    continuation bytes to the start of a character.
    """
    full = [(i, key, text.encode()) for i, (key, text) in enumerate(rows) if text]
    ends = list(accumulate(len(raw) for _, _, raw in full))
    edge = bisect_left(ends, max_bytes)
    if edge == len(full):
        return [(key, raw.decode()) for _, key, raw in full], len(rows)
    i, key, raw = full[edge]
    cut = max_bytes - (ends[edge] - len(raw))
    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
        cut -= 1
    kept = [(k, r.decode()) for _, k, r in full[:edge]]
    return kept + [(key, raw[:cut].decode())] * (cut > 0), i + 1


def library_model(texts, vocab_size):
    tokenizer = ByteLevelBPETokenizer()
    tokenizer.train_from_iterator(
        texts, vocab_size=vocab_size, min_frequency=0, special_tokens=["[UNK]"], show_progress=False
    )
    return tokenizer


def library_merges(tokenizer):
    return [tuple(pair) for pair in json.loads(tokenizer.to_str())["model"]["merges"]]
