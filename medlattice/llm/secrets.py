"""Secret scans: candidates by pattern, false positives removed by a random forest that is trained here on labelled findings."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, table

#: Characters on either side of a candidate that its features see.
AROUND = 60
#: Prefixes that issuers give their keys.
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "ya29.", "SG.", "npm_", "dop_v1_", "eyJ")
#: Neighbouring words that speak for and against a secret, and words that make up harmless values.
FOR = frozenset("token secret password passwd pwd apikey api_key key auth authorization bearer credential credentials private access client_secret passphrase".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 checksum digest hash uuid guid id revision rev build version etag src href path file image example sample placeholder dummy test public fingerprint".split())
WORDS = (
    "the and for with from this that have not are was user users name file files path test data example sample your here change me password secret token key value default home local "
    "admin root server client config build version release image images static assets public private project source target main index page list item items get set new old class "
    "function string number object array type error message request response header content service manager controller handler factory"
).split()
_KEYED = re.compile(r"(?i)\b([a-z0-9_.-]*(?:token|secret|passw(?:or)?d|passwd|pwd|api_?key|access_?key|auth|credential|private_?key|passphrase)[a-z0-9_.-]*)[\"']?\s*(?::=|=>|[:=])\s*[\"']?([^\s\"'<>,;]{8,}+)")
_ISSUED = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, ISSUED)) + r")[A-Za-z0-9_\-.]{12,}+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_\-]{24,}+={0,2}+(?![A-Za-z0-9+/_=\-])")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\-]*+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_COVER = re.compile("|".join(sorted((w for w in WORDS if len(w) > 2), key=len, reverse=True)), re.IGNORECASE)
FEATURES = ("length", "entropy", "digits", "capitals", "marks", "changes", "hex", "longest_run", "coverage", "slashes", "in_path", "quoted", "assigned", "words_for", "words_against", "issued", "distinct", "vowels")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of what may be a secret, in order; of overlapping ones the first by kind issued, keyed, token stays. None is too long."""
    found: list[tuple[int, int, str]] = []  # in order, and apart
    for kind, pattern in (("private_key", _PEM), ("issued", _ISSUED), ("keyed", _KEYED), ("token", _TOKEN)):
        for m in pattern.finditer(text):
            b, e = m.span(2) if kind == "keyed" else m.span()
            if kind == "private_key":
                e = _pem_end(text, e)
            if kind == "token" and not _DIGIT.search(text, b, e):
                continue
            at = bisect.bisect_left(found, (b,))
            if (at == 0 or found[at - 1][1] <= b) and (at == len(found) or e <= found[at][0]):
                found.insert(at, (b, e, kind))
    return found


def _pem_end(text: str, begin: int) -> int:
    """Where a private key ends whose header ends at begin: behind its footer, if nothing but a key lies between."""
    footer = text.find("-----END ", begin)
    end = text.find("-----", footer + 9) + 5 if footer >= 0 else 4
    return end if end > 4 and _PEM_BODY.fullmatch(text, begin, footer) else begin


def features(text: str, begin: int, end: int) -> list[float]:
    v = text[begin:end]
    n = len(v)
    before, after = text[max(0, begin - AROUND) : begin], text[end : end + AROUND]
    near = [w.lower() for w in _WORD.findall(before)[-5:] + _WORD.findall(after)[:3]]
    parts = {p for w in near for p in (w, *w.split("_"))}
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in v]
    count = np.unique(np.frombuffer(v.encode("utf-32-le"), np.uint32), return_counts=True)[1] / n
    run = longest = 1
    for x, y in zip(v, v[1:], strict=False):
        run = run + 1 if x == y else 1
        longest = max(longest, run)
    return [
        min(n, 200), float(-(count * np.log2(count)).sum()), kind.count(0) / n, kind.count(2) / n, kind.count(3) / n, sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(1, n - 1),
        float(all(c in "0123456789abcdefABCDEF" for c in v)), longest, sum(len(w) for w in _COVER.findall(v)) / n, v.count("/"), float(before[-1:] in ("/", ".", "\\") or after[:1] in ("/", "\\")),
        float(before[-1:] in ("'", '"', "`") and bool(before)), float(bool(re.search(r"[:=]\s*[\"'`]?$", before))), len(parts & FOR), len(parts & AGAINST), float(v.startswith(ISSUED)), len(count), sum(c in "aeiouAEIOU" for c in v) / n,
    ]


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, begin, end, label) of n findings, half of them secrets, made by rule: keys of many formats where they are used, and
    what scanners take for keys (checksums, ids, paths, placeholders, encoded words)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    prose = lambda: " ".join(draw(lower, int(rng.integers(2, 9))) for _ in range(int(rng.integers(1, 6))))
    hexes, mixed = digits + "abcdef", lower + upper + digits
    out = []
    for i in range(n):
        if i % 2:
            value = pick([lambda: draw(hexes, int(pick([32, 40, 48, 64]))), lambda: draw(mixed, int(rng.integers(20, 60))), lambda: pick(ISSUED[:-1]) + draw(mixed, int(rng.integers(16, 40))), lambda: draw(mixed + "!@#$%^&*", int(rng.integers(10, 24))), lambda: draw(mixed + "+/", 43) + "="])()
            name = pick(["token", "api_key", "apiKey", "secret", "password", "auth_token", "AWS_SECRET_ACCESS_KEY", "client_secret", "access_token", "passwd"])
            lead = pick([f"{name} = \"", f"{name}: ", f"{name}=", f"\"{name}\": \"", f"export {name.upper()}=", "Authorization: Bearer ", f"{name} => '"])
        else:
            value, lead = pick([
                lambda: (draw(hexes, 40), pick(["commit ", "revision ", "sha1: ", "rev=", "git sha "])), lambda: (draw(hexes, 64), pick(["sha256:", "checksum = ", "digest: ", "etag=\""])),
                lambda: ("-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12)), pick(["uuid=", "id: ", "guid = \"", "request id "])), lambda: ("/".join(pick(WORDS) for _ in range(6)) + f"/{draw(digits, 2)}", pick(["path=", "src=\"", "file: ", "see "])),
                lambda: (pick(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxxxxxx", "example-secret-value-1", "<token>placeholder0", "test_password_123", "insert-token-here-000"]), pick(["token = \"", "api_key: ", "password=", "secret = '"])),
                lambda: ("".join(pick(WORDS).title() for _ in range(5)) + draw(digits, 1), pick(["class ", "token: ", "new ", "key = "])), lambda: ("_".join(pick(WORDS) for _ in range(5)) + f"_{draw(digits, 2)}", pick(["auth = ", "password: get_", "secret_name=", "call "])),
                lambda: ("-" * 20 + draw(digits, 6), pick(["", "line "])), lambda: (draw(digits, int(rng.integers(24, 40))), pick(["number ", "id=", "total: "])),
            ])()
        text = f"{prose()} {lead}"
        begin = len(text)
        out.append((f"{text}{value}{'\"' if lead[-1:] == '\"' else ''} {prose()}", begin, begin + len(value), i % 2))
    return out


@dataclass
class Tree:
    """Nodes as arrays: feature (-1: leaf), threshold, children, share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            go = np.flatnonzero(inner)
            here = at[go]
            at[go] = np.where(x[go, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])
        return self.share[at]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = 9, least: int = 4) -> Tree:
    """A tree by Gini splits, each over a random few of the features."""
    nodes: list[list] = []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if level >= depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(rows))
            ok = (v[1:] > v[:-1]) & (k >= least) & (len(rows) - k >= least)
            if ok.any():
                p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(rows) - k)
                gain = np.where(ok, share * (1 - share) - (k * p * (1 - p) + (len(rows) - k) * q * (1 - q)) / len(rows), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            to = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = node(rows[to], level + 1)
            nodes[me][3] = node(rows[~to], level + 1)
        return me

    node(rng.integers(0, len(x), len(x)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


@dataclass
class Forest:
    trees: list[Tree]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def fit_forest(findings: list[tuple[str, int, int, int]], trees: int = 40, seed: int = 5) -> Forest:
    x = np.array([features(t, b, e) for t, b, e, _ in findings])
    y = np.array([label for *_, label in findings], float)
    rng = np.random.default_rng(seed)
    return Forest([grow(x, y, rng) for _ in range(trees)])


def secrets(docs: DataFrame, forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """A row for each finding whose score reaches least: doc_id, begin, end (in characters), kind, score, value_crc32.

    The whole text is searched. Private key headers are findings by themselves (score 1). Null and empty texts have none; repeated
    rows and repeated values are reported each time; values overlapping an earlier kind's are reported once. The forest is
    fitted on labelled_findings() unless one is given.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest or fit_forest(labelled_findings()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                rows, x = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for b, e, kind in candidates(text):
                        rows.append((doc, b, e, kind, zlib.crc32(text[b:e].encode())))
                        x.append(features(text, b, e))
                if rows:
                    score = model.value(np.array(x))
                    score[[r[3] == "private_key" for r in rows]] = 1.0
                    keep = np.flatnonzero(score >= least).tolist()
                    cols = list(zip(*(rows[i] for i in keep), strict=True)) if keep else [()] * 5
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(score[keep])], names=["doc_id", "begin", "end", "kind", "value_crc32", "score"])

    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin long, end long, kind string, value_crc32 long, score double")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
