"""Texts and benchmark items that hold every edge case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, fp string, shard int, n_tokens string, before int"


def make_texts() -> list[tuple]:
    """(doc_id, text): nulls, blanks, ties, repeats, near copies, shared passages, odd characters, one long text."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefghiklmnoprstuvwäéß") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows = [(i, sentence(draw.randint(3, 150))) for i in range(60)]
    passage = sentence(60)
    for i in range(60, 70):
        rows.append((i, sentence(30) + " " + passage + "\n" + sentence(20)))
    for i in range(70, 80):
        words = rows[3][1].split() * 2
        words[draw.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(80, rows[5][1]), (81, rows[5][1]), (82, None), (83, ""), (84, " \t\n"), (None, "no id at all but a text of some words"), (85, "a"), (85, "same id again"), (85, "same id again")]
    rows += [(86, "Licensed under the MIT License. mit license MIT-license Apache License, GENERAL public License"), (87, "GNU General Public License, version 3 the MIT\nLicense"), (88, "x y " * 40), (89, "line one here\nline one here\n\nother")]
    rows += [(90, "mail a.b@c-d.co.uk, then 10.0.0.255 or 300.1.1.1; card 4111 1111 1111 1111 tel +1 (234) 555-1234; 4111-1111-1111-1112")]
    rows += [(91, "<|endoftext|> <s> </s> <unk> ▁ ▁▁  　 日本語 \U0001f600 \x00\x01 İ ß ΑΣ don't I'LL **bold** #1"), (92, "  two  spaces   here "), (93, "▁" * 5), (94, "#*$%&|<> " * 5)]
    rows += [(95 + i, f"token = \"{draw.getrandbits(160):040x}\" " + sentence(12)) for i in range(6)]
    rows += [(101, "token = \"" + "9F" * 20 + "\" " + sentence(12)), (102, sentence(6000) + " " + passage), (103, rows[1][1].upper()), (104, "ab" * 200), (105, "ab" * 150)]
    # Enough of a pattern, and of other identifiers, that chance does not explain it.
    rows += [(106 + i, f"token = \"{draw.getrandbits(160):040x}\" " + sentence(12)) for i in range(24)]
    rows += [(130 + i, sentence(4) + f" room {700_000 + 37 * i} " + sentence(8)) for i in range(60)]
    return rows


TEXTS = make_texts()
BENCHMARK = [(1, " ".join(TEXTS[2][1].split()[2:18])), (2, "zebra " * 12), (10, TEXTS[65][1].split("\n")[0][-200:]), (3, "a"), (4, None), (None, "no id"), (5, ""), (1, " ".join(TEXTS[2][1].split()[2:18])), (7, "mit license")]
