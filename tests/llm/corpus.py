"""Small made-up corpora with planted cases."""

import random

WORDS = ["alder", "birch", "cedar", "doum", "Elm", "fir", "gum", "hazel", "ivy", "Jarrah", "kauri", "larch", "maple", "neem", "oak", "pine"]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text): passages shared across documents, copies, near copies, repeated ids and rows, null and empty texts, odd spaces."""
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(5, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [words(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), words(rng, rng.randrange(10))]
        flat = [w for p in parts for w in p]
        out.append((i * 3 % 101, rng.choice([" ", "\n", " \t", "  ", "\x0b"]).join(flat)))
    for i in range(10):
        source = rng.choice(out)[1]
        out.append((200 + i, source))
        cut = source.split(" ")
        if len(cut) > 3:
            cut[rng.randrange(len(cut))] = "changed"
        out.append((300 + i, " ".join(cut)))
    out += [(None, out[0][1]), (None, None), (5, out[3][1]), (400, None), (401, ""), (402, "  \n "), (403, "one"), (404, "ÉÀ é À Ünï " * 9), (405, "a " * 400), (405, "a " * 400)]
    rng.shuffle(out)
    return out
