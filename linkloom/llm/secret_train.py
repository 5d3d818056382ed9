"""Trains the forest of secret_scan on labelled findings: python -m linkloom.llm.secret_train.

The findings are made up from a seed: keys in the usual shapes and places (secrets), and digests,
identifiers, paths, numbers, samples and names that look like keys (false positives).
"""

from __future__ import annotations

import json
import random
import string
from pathlib import Path

import numpy as np

from .secret_scan import DICTIONARY, FEATURES, candidates, with_features

HEX, B62 = "0123456789abcdef", string.ascii_letters + string.digits
#: Parts of passphrases, and what stands behind a name without being a secret.
PLAIN = "correct horse battery staple purple monkey dragon summer winter tiger orange coffee silver river mountain guitar rocket ninja flower banana cactus velvet copper magnet".split()
STATES = "none null true false required optional string hidden missing changed expired invalid empty unset below reset redacted".split()


def finding(r: random.Random) -> tuple[str, int]:
    """A text with one candidate, and 1 if that is a secret."""
    rnd = lambda chars, lo, hi=None: "".join(r.choice(chars) for _ in range(r.randint(lo, hi or lo)))
    words = lambda n: " ".join(r.choice(["the", "in", "thation", "of", "ered", "con", "und", "que", "onthe", "mail6.example.com", "Asanstestion"]) for _ in range(n))
    lead, tail = words(r.randint(0, 5)) + " ", " " + words(r.randint(0, 4))
    if r.random() < 0.08:
        return addressed(r, rnd, lead, tail)
    if r.random() < 0.4:
        return unlike_keys(r, rnd, lead, tail)
    if r.random() < 0.5:
        name = r.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "API key", "client_secret", "private key", "credentials"])
        value = r.choice([lambda: rnd(HEX, 32), lambda: rnd(HEX, 40), lambda: rnd(HEX, 64), lambda: rnd(B62, 20, 48), lambda: "AKIA" + rnd(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + rnd(B62, 36), lambda: "sk_live_" + rnd(B62, 24), lambda: rnd(B62 + "+/", 40), lambda: "xoxb-" + rnd(string.digits, 12) + "-" + rnd(B62, 24)])()
        link = r.choice([' = "', "=", ": ", '="', ": '", " := ", " "])
        if link == " " and not value.startswith(("AKIA", "ghp_", "sk_", "xox")):
            link = " = "
        text = r.choice([f'{lead}{name}{link}{value}"{tail}', f"{lead}Authorization: Bearer {value}{tail}"]) if r.random() < 0.9 else f"{lead}{value}{tail}" if value[:3] in ("AKI", "ghp", "sk_", "xox") else f"{lead}{name} {value}{tail}"
        return text, 1
    kind = r.randrange(9)
    if kind == 0:
        return f"{lead}{r.choice(['sha256', 'commit', 'md5', 'checksum', 'digest', 'revision', 'etag'])}{r.choice([': ', ' ', '='])}{rnd(HEX, r.choice([32, 40, 64]))}{tail}", 0
    if kind == 1:
        return f"{lead}{r.choice(['uuid', 'id', 'request id'])} {'-'.join(rnd(HEX, n) for n in (8, 4, 4, 4, 12))}{tail}", 0
    if kind == 2:
        return f"{lead}https://{r.choice(DICTIONARY)}.example.com/{'/'.join(r.choice(DICTIONARY) for _ in range(r.randint(2, 5)))}-{r.randint(1, 9999)}{tail}", 0
    if kind == 3:
        return f"{lead}{rnd(string.digits, 16, 24)}{tail}", 0
    if kind == 4:
        return f"{lead}{r.choice(['order', 'invoice', 'phone', 'IBAN', 'isbn'])} {rnd(string.digits + 'DE', 16, 22)}{tail}", 0
    if kind == 5:
        return f"{lead}{r.choice(['token', 'api_key', 'secret'])} = \"{r.choice(['your', 'example', 'test', 'sample', 'dummy'])}{r.choice(['_', '-', ''])}{r.choice(['api_key', 'token', 'secret_value', 'placeholder'])}{r.choice(['_1234567890', '000000000', '_12345'])}\"{tail}", 0
    if kind == 6:
        return f"{lead}{r.choice(['_', '-']).join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6)))}{r.randint(1, 99)}{tail}", 0
    if kind == 7:
        return f"{lead}{''.join(r.choice(['th', 'er', 'ing', 'on', 'ver', 'que', 'ment']) for _ in range(r.randint(6, 12)))}{r.randint(1, 9)}{tail}", 0
    return f"{lead}{r.choice(['token', 'key', 'password'])}: {r.choice('x0a')*r.randint(16, 32)}{r.randint(0, 9)}{tail}", 0


def addressed(r: random.Random, rnd, lead: str, tail: str) -> tuple[str, int]:
    """A signed web token, or an address with a password or a sample of one."""
    if r.random() < 0.4:
        token = f"eyJ{rnd(B62, 12, 40)}.eyJ{rnd(B62 + '_-', 20, 120)}.{rnd(B62 + '_-', 20, 60)}"
        return f"{lead}{r.choice(['Authorization: Bearer ', 'token = ', '', 'jwt '])}{token}{tail}", 1
    value, secret = r.choice([(rnd(B62, 8, 24), 1), (r.choice(PLAIN) + rnd(string.digits, 1, 4), 1), (rnd(B62 + "!#%&*", 8, 16), 1), (r.choice(["password", "your_password", "example", "xxxx", "changeme", "<password>"[1:-1]]), 0)])
    return f"{lead}{r.choice(['postgres', 'https', 'mysql', 'ftp', 'amqp', 'redis'])}://{r.choice(['user', 'admin', 'app', 'root'])}:{value}@{r.choice(['db', 'host', 'files'])}.example.com/{r.choice(['', 'data', 'x?y=1'])}{tail}", secret


def unlike_keys(r: random.Random, rnd, lead: str, tail: str) -> tuple[str, int]:
    """A finding that is short, or of letters only: passwords and passphrases; states, prose and code behind the names of secrets."""
    name = r.choice(["token", "api_key", "secret", "password", "passwd", "db_password", "access_key", "auth_token", "client_secret", "passphrase"])
    if r.random() < 0.5:
        letters = lambda: rnd(string.ascii_letters, 16, 48)
        value = r.choice([letters, letters, lambda: "".join(r.choice(PLAIN) for _ in range(r.randint(2, 5))), lambda: "-".join(r.choice(PLAIN) for _ in range(r.randint(3, 5))), lambda: r.choice(PLAIN) + rnd(string.digits, 1, 4), lambda: rnd(B62, 8, 15), lambda: r.choice(string.ascii_letters) + rnd(B62 + "!@#%&*", 6, 12) + r.choice(B62)])()
        if r.random() < 0.1:
            return f"{lead}{'AKIA' + rnd(string.ascii_uppercase, 16)}{tail}", 1
        link, end = r.choice([(' = "', '"'), ('="', '"'), (": '", "'"), (': "', '"'), ("=", ""), (" = ", "")])
        return f"{lead}{name}{link}{value}{end}{tail}", 1
    prose = lambda: "".join(r.choice(["th", "er", "ing", "on", "ver", "que", "ment", "keit", "lich"]) for _ in range(r.randint(1, 12)))
    kind = r.randrange(4)
    if kind == 0:
        return f"{lead}{name}{r.choice([': ', ' = ', '=', ': '])}{r.choice(STATES)}{tail}", 0
    if kind == 1:
        return f"{lead}{name}: {prose()}{tail}", 0
    if kind == 2:
        return f"{lead}{name}{r.choice([' = ', '=', ': '])}{r.choice(['config', 'os', 'self', 'settings', 'request'])}.{r.choice(['environ', 'get_secret', 'headers', 'credentials', 'value'])}{r.choice(['', '()', '(x)'])}{tail}", 0
    return f"{lead}{name} = \"{r.choice(['your', 'example', 'test', 'sample', 'dummy'])}{r.choice(['_', '-', ''])}{r.choice(['password', 'token', 'secret', 'value', 'placeholder'])}\"{tail}", 0


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int) -> list | float:
    """A tree: [feature, cut, not above, above] or the share of secrets."""
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return round(float(y.mean()), 4)
    best = (np.inf, 0, 0.0)
    for j in rng.choice(x.shape[1], 5, replace=False):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 15))):
            low = x[:, j] <= cut
            if low.all() or not low.any():
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            best = min(best, (impurity, j, float(cut)))
    if best[0] == np.inf:
        return round(float(y.mean()), 4)
    low = x[:, best[1]] <= best[2]
    return [names[best[1]], round(best[2], 6), grow(x[low], y[low], names, rng, depth - 1), grow(x[~low], y[~low], names, rng, depth - 1)]


def predict(forest: list, row: dict[str, float]) -> float:
    def walk(node):
        while isinstance(node, list):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return sum(map(walk, forest)) / len(forest)


def main(findings: int = 20000, trees: int = 15, depth: int = 6, seed: int = 6) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    r = random.Random(seed)
    made = [finding(r) for _ in range(findings)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    rows = with_features(candidates(docs)).collect()
    names = list(FEATURES)
    x = np.array([[row[f"f_{n}"] for n in names] for row in rows])
    y = np.array([made[row["doc_id"]][1] for row in rows], float)
    found = np.array([row["doc_id"] for row in rows])
    held = np.array([row["doc_id"] % 5 == 0 for row in rows])
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        some = rng.choice(np.flatnonzero(~held), (~held).sum())
        forest.append(grow(x[some], y[some], names, rng, depth))
    guess = np.array([predict(forest, dict(zip(names, v, strict=True))) >= 0.5 for v in x[held]])
    secrets = [i for i in range(0, findings, 5) if made[i][1]]  # those without a candidate are misses
    recall = np.isin(secrets, found[held][guess]).mean()
    print(f"{len(rows)} candidates of {findings}; held out: {np.mean(guess == y[held]):.4f} right, precision {y[held][guess].mean():.4f}, recall {recall:.4f}, {len(secrets) - np.isin(secrets, found).sum()} of {len(secrets)} secrets without a candidate")
    Path(__file__).with_name("secret_forest.json").write_text(json.dumps(forest) + "\n")


if __name__ == "__main__":
    main()
