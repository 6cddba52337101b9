import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


#: Null, empty, blank, one letter, copies, near copies, several lines, odd characters, a very long text.
TEXTS = [None, "", " ", "x", prose(1, 60), prose(1, 60), prose(1, 60) + " end", prose(2, 40) + "\n" + prose(3, 80), prose(4, 30) + "\n" + prose(3, 80) + "\nlast", "É ß 日本 🎉 <|endoftext|> ́a\r\n\tb\x0bc　d", "ab" * 3000, prose(5, 30_000), None, "", prose(1, 60)]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
