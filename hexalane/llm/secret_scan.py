"""Secret scanning with a random forest that removes false positives.

Wide patterns propose candidates; a random forest (Spark ML), trained from
labelled findings, decides which are secrets.  Its inputs are the candidate's
length, its character classes and transitions, its coverage by dictionary words,
the path, and the neighbouring words.

The forest is trained as a Spark job, saved to the shared folder, and read back
as a table of tree nodes (at most ``TREES * 2 ** (DEPTH + 1)`` rows), which the
scanning tasks evaluate next to the texts: one pass, no join, no shuffle.
"""

import math
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import tidy
from .work import fresh_path

TREES, DEPTH, SEED = 24, 8, 11
THRESHOLD = 0.5
REDACTED = "[SECRET]"
#: Rows whose texts a task holds as Python strings at a time.
ROWS = 512

KEY_NAME = re.compile(r"(?i)passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential")
#: A name and the sign after it; a name begins where its run of letters does, so that no run is tried twice.
NAMED = re.compile(r"(?<![\w-])[\w-]{3,}+[\"']?[ \t]*+[=:][ \t]*+[\"']?")
VALUE = re.compile(r"[^\s\"'<>]{8,}")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
DIGIT = re.compile("[0-9]")
KEY_ID = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")
#: Kinds of candidates; where two hits overlap, the lower one stays.
KEY, VALUE_OF_KEY, RUN = range(3)

# Words that mark a secret, words that mark a harmless value, and common parts of identifiers.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "credential", "credentials", "auth", "bearer", "private", "login")
HARMLESS_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "test", "commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "hash", "etag", "version", "revision", "http", "https", "href", "src", "id", "isbn", "order", "invoice", "tracking")
DICTIONARY = (
    "the and for that with this from have your here name user file data test code list time date page site home main info text type size view item node path link note body head form view "
    "index image video photo admin login local value table chart model class style script module engine server client result report version release example sample change insert update delete "
    "select create random string number letter secret token password private public access account service project company product message network storage internet international system update"
).split()
WORDS = re.compile(r"[A-Za-z_]{2,}")
N_FEATURES = 20


def features(candidate: str, tail: str, near: list[str], later: list[str], path: str) -> list[float]:
    """The forest's inputs for a candidate, the last character before it, and the three words before and two after it."""
    n = len(candidate)
    lower = candidate.lower()
    kinds = ["d" if c.isdigit() else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "s" for c in candidate]
    counts = {c: candidate.count(c) for c in set(candidate)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    transitions = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    repeats = sum(a == b for a, b in zip(candidate, candidate[1:])) / max(1, n - 1)
    ordered = sum(ord(b) - ord(a) == 1 for a, b in zip(candidate, candidate[1:])) / max(1, n - 1)
    letters = [c for c in lower if c.isalpha()]
    vowels = sum(c in "aeiou" for c in letters) / max(1, len(letters))
    covered = bytearray(n)
    for word in DICTIONARY:
        at = lower.find(word)
        while at >= 0:
            covered[at : at + len(word)] = b"\1" * len(word)
            at = lower.find(word, at + 1)
    return [
        float(min(n, 128)),
        kinds.count("d") / n,
        kinds.count("l") / n,
        kinds.count("u") / n,
        kinds.count("s") / n,
        entropy,
        transitions,
        repeats,
        ordered,
        vowels,
        sum(covered) / n,
        float(all(c in "0123456789abcdef" for c in lower)),
        float(len(counts)) / n,
        float(candidate[:4] in ("AKIA", "ASIA", "ghp_", "gho_", "xoxb", "xoxp") or candidate[:3] in ("sk-", "eyJ")),
        float(any(k in w for w in near for k in KEY_WORDS)),
        float(any(w in HARMLESS_WORDS for w in near + later)),
        float(tail in ("=", ":")),
        float(candidate.count("-") == 4 and n == 36),
        float(bool(re.search(r"(?i)(^|[/_.-])(tests?|docs?|examples?|fixtures?|samples?)([/_.-]|$)", path))),
        float(bool(re.search(r"(?i)\.(env|ya?ml|json|ini|cfg|conf|properties|pem|key|tf)$", path))),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` of every span that may be a secret, overlapping ones too: key ids, values given to a telling name, long runs with a digit."""
    found = {m.span(): KEY for m in KEY_ID.finditer(text)}
    named = [m for m in NAMED.finditer(text) if KEY_NAME.search(text, m.start(), m.end())]
    for m, later in zip(named, [*(n.start() for n in named[1:]), len(text)]):
        # a value ends where the next telling name begins, so that chains of names are read once
        value = VALUE.match(text, m.end(), max(later, m.end()))
        if value:
            found.setdefault(value.span(), VALUE_OF_KEY)
    for m in LONG_RUN.finditer(text):
        if DIGIT.search(text, m.start(), m.end()):
            found.setdefault(m.span(), RUN)
    return sorted((s, e, kind) for (s, e), kind in found.items())


def chosen(hits: list[tuple[int, int, int, float]]) -> list[tuple[int, int, float]]:
    """Hits ``start, end, kind, probability`` without overlaps, in order: lower kinds first, then the more probable, then the earlier."""
    starts, ends, out = [], [], []
    for s, e, _, q in sorted(hits, key=lambda h: (h[2], -h[3], h[0], h[1])):
        i = bisect_left(ends, s + 1)
        if i == len(starts) or starts[i] >= e:
            starts.insert(i, s)
            ends.insert(i, e)
            out.insert(i, (s, e, q))
    return out


class Neighbours:
    """The words of a text, to look up those next to a span whatever their distance."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in WORDS.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def features(self, start: int, end: int, path: str) -> list[float]:
        last, first = bisect_right(self.ends, start), bisect_left(self.starts, end)
        word = lambda i: self.text[self.starts[i] : self.ends[i]].lower()
        at = start - 1
        while at >= 0 and self.text[at] in " \t\"'":
            at -= 1
        near = [word(i) for i in range(max(0, last - 3), last)]
        later = [word(i) for i in range(first, min(first + 2, len(self.starts)))]
        return features(self.text[start:end], self.text[at : at + 1] if at >= 0 else "", near, later, path)


def span_features(text: str, start: int, end: int, path: str) -> list[float]:
    return Neighbours(text).features(start, end, path)


def labelled_findings(spark: SparkSession, n: int = 6_000, seed: int = 5) -> DataFrame:
    """``text, start, end, path, label``: findings made by rule, half of them secrets, for training and tests.

    Secrets follow documented token formats or are random strings in an
    assignment; the rest are placeholders, digests, identifiers, slugs, numbers
    and the like.  Any table of reviewed findings with these columns may be used
    instead.
    """
    rng = random.Random(seed)
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve un la que der sch ung ment".split()

    def pick(alphabet, k):
        return "".join(rng.choice(alphabet) for _ in range(k))

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))

    def phrase(k):
        return " ".join(word() for _ in range(k))

    def secret():
        kind = rng.randrange(8)
        key = rng.choice(["password", "passwd", "token", "secret", "api_key", "auth_token", "client_secret", "access_key"])
        sign = rng.choice(["=", " = ", ": ", '="', ' = "', ': "'])
        if kind == 0:
            return "", "AKIA" + pick(upper, 16)
        if kind == 1:
            return "", rng.choice(["ghp_", "gho_"]) + pick(mixed, 36)
        if kind == 2:
            return rng.choice(["", key + sign]), "sk-" + pick(mixed, 48)
        if kind == 3:
            return rng.choice(["", "Bearer ", key + sign]), "eyJ" + pick(mixed + "-_", rng.randint(40, 120))
        if kind in (4, 5):
            return key + sign, pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))
        if kind == 6:
            return key + sign, pick(mixed + "+/", rng.choice([20, 32, 40, 44]))
        return key + sign, pick(mixed, rng.randint(10, 20))

    def harmless():
        kind = rng.randrange(14)
        if kind == 0:
            return rng.choice(["commit ", "sha1 ", "md5 ", "checksum ", "digest: ", "etag ", "revision ", "hash "]), pick(hexa, rng.choice([32, 40, 64]))
        if kind == 1:
            h = pick(hexa, 32)
            return rng.choice(["", "id: ", "uuid ", "id="]), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        if kind == 2:
            return "/", "-".join(word() for _ in range(rng.randint(3, 7))) + f"-{rng.randint(1, 2030)}"
        if kind == 3:
            return rng.choice(["", "card ", "no. ", "tel "]), pick("0123456789", rng.randint(16, 24))
        if kind == 4:
            return rng.choice(["password=", "token: ", "secret=", "api_key = "]), rng.choice(["changeme12345678", "your_token_here_1234", "example_password_01", "placeholder123456", "insert-secret-here-1", "<password>12345678"]).strip("<>")
        if kind == 5:
            return "", "AKIA" + pick(upper, 9) + "EXAMPLE"
        if kind == 6:
            return "", "".join(word().capitalize() for _ in range(rng.randint(4, 7))) + str(rng.randint(1, 99))
        if kind == 7:
            return "", f"IMG_{rng.randint(20000101, 20301231)}_{pick('0123456789', 6)}"
        if kind == 8:
            return "", rng.choice("ab0-=_x") * rng.randint(16, 40) + "1"
        if kind == 9:
            return "", "0123456789abcdefghijklmnop"[: rng.randint(16, 26)]
        if kind == 10:
            return "https://" + word() + ".example/", "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 9999)}"
        if kind == 11:
            return rng.choice(["password: ", "token: ", "secret: "]), "".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["", ".", ","])
        if kind == 12:
            return "", "_".join(word() for _ in range(rng.randint(3, 6))) + f"_{rng.randint(1, 99)}"
        return "", "".join(word() for _ in range(rng.randint(4, 7))) + str(rng.randint(1, 99))

    rows = []
    for i in range(n):
        label = i % 2
        lead, value = secret() if label else harmless()
        before = phrase(rng.randint(0, 5))
        text = f"{before} {lead}" if before else lead
        start = len(text)
        quote = '"' if lead.endswith('"') else ""
        path = rng.choice(["src0", "src7", "web", ""] * 3 + (["config/app.env", "deploy/values.yaml"] if label else ["docs/guide.md", "tests/data.json"]))
        rows.append((f"{text}{value}{quote} {phrase(rng.randint(0, 4))}", start, start + len(value), path, label))
    return spark.createDataFrame(rows, "text string, start int, end int, path string, label int")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> dict:
    """Tree nodes as arrays, from labelled findings ``text, start, end, path, label``; nulls in any of them leave the row out."""
    spark = findings.sparkSession

    def inputs(frames):
        for pdf in frames:
            yield pdf.assign(x=[span_features(t, s, e, p) for t, s, e, p in zip(pdf.text, pdf.start, pdf.end, pdf.path)])[["x", "label"]]

    rows = findings.dropna(subset=["text", "start", "end", "label"]).fillna({"path": ""}).select("text", "start", "end", "path", F.col("label").cast("double").alias("label")).where("end > start")
    vectors = rows.mapInPandas(inputs, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return _nodes(spark, forest)


def _nodes(spark: SparkSession, forest) -> dict:
    path = fresh_path(spark, "forest")
    forest.save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    p = table.toPandas().sort_values(["treeID", "id"])
    base = {t: i for t, i in zip(*np.unique(p["treeID"].to_numpy(), return_index=True))}
    offset = p["treeID"].map(base).to_numpy()
    split = list(p["split"])
    leaf = p["leftChild"].to_numpy() < 0
    stats = [np.asarray(s, float) for s in p["impurityStats"]]
    return {
        "roots": np.array(sorted(base.values())),
        "feature": np.array([0 if x else s["featureIndex"] for x, s in zip(leaf, split)]),
        "threshold": np.array([0.0 if x else s["leftCategoriesOrThreshold"][0] for x, s in zip(leaf, split)]),
        "left": np.where(leaf, -1, p["leftChild"].to_numpy() + offset),
        "right": np.where(leaf, -1, p["rightChild"].to_numpy() + offset),
        "p": np.array([s[1] / s.sum() if s.sum() else 0.5 for s in stats]),
    }


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """Mean over trees of the share of secrets in the leaf that each row of ``x`` reaches."""
    total = np.zeros(len(x))
    for root in model["roots"]:
        at = np.full(len(x), root)
        while True:
            inner = np.flatnonzero(model["left"][at] >= 0)
            if not len(inner):
                break
            i = at[inner]
            go = x[inner, model["feature"][i]] <= model["threshold"][i]
            at[inner] = np.where(go, model["left"][i], model["right"][i])
        total += model["p"][at]
    return total / max(1, len(model["roots"]))


def scan(docs: DataFrame, model: dict, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``__n_candidates``, ``__spans`` (``start``, ``end``, ``probability``) and ``__redacted``.

    Spans are in code points, end exclusive, in order, without overlaps: of
    overlapping hits the one of the surer kind stays, then the more probable, then
    the earlier.  A null text has no candidates and stays null; a null path counts
    as an empty one; texts are read whole.  Rows are mapped one by one: repeated
    rows and empty tables need no rule.  Columns of ``docs`` that are named like
    the three added ones give way to them.
    """
    docs = docs.drop("__n_candidates", "__spans", "__redacted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text_at, path_at = names.index(text_col), names.index(path_col)
    span = T.StructType().add("start", "long").add("end", "long").add("probability", "double")
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_candidates", T.LongType()), T.StructField("__spans", T.ArrayType(span)), T.StructField("__redacted", T.StringType())])

    def run(batches):
        forest = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        # some rows at a time: their texts exist as Python strings twice
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts, paths = batch.column(text_at).to_pylist(), batch.column(path_at).to_pylist()
            found = [candidates(t) if t else [] for t in texts]
            x = []
            for text, path, own in zip(texts, paths, found):
                if own:
                    words = Neighbours(text)
                    x += [words.features(s, e, str(path or "")) for s, e, _ in own]
            p = iter(probability(forest, np.array(x)) if x else ())
            spans, out = [], []
            for text, own in zip(texts, found):
                scored = [(s, e, kind, float(next(p))) for s, e, kind in own]
                hits = chosen([h for h in scored if h[3] >= threshold])
                spans.append([{"start": s, "end": e, "probability": q} for s, e, q in hits])
                if hits:
                    cuts = [0, *(at for s, e, _ in hits for at in (s, e)), len(text)]
                    text = REDACTED.join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append(text)
            extra = [pa.array([len(f) for f in found], pa.int64()), pa.array(spans, kind), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "__n_candidates", "__spans", "__redacted"])

    return docs.mapInArrow(tidy(run), schema)
