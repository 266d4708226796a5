r"""Personal data in texts: strict patterns, and further spans by weak supervision.

Strict patterns give the base: e-mail addresses, IPv4 addresses, card numbers and telephone numbers. What they miss (numbers that run into each
other, spelled-out addresses, telephone numbers without a plus) is proposed by wider patterns. Every proposal and every base span is
voted on by labelers, each of which says yes, says no or abstains: a pattern labeler, a checksum or validity labeler, gazetteers
(issuers of cards, country codes, domain endings, reserved addresses), the characters at the span's ends, words of four languages around it,
its grouping and the variety of its digits.

How often each labeler gives each vote for true and for false spans is estimated by expectation-maximisation for each kind, over the counts of
vote patterns in all documents. The posteriors are the soft labels on which a logistic classifier is fitted; it sees the votes and features that no labeler
uses. Votes and features have few values each, so that the distinct combinations are what is counted in Spark and sent to
the driver, however many spans there are. Proposals that the classifier gives at least `threshold` are added where they overlap neither the base nor a better proposal.

Defined cases: null and empty texts have no spans. Rows are taken one by one, whatever their doc_id. Very long texts are read whole, in time that grows with
their length. Of proposals that overlap the likeliest stays, of equally likely ones the longest, then the first. Without any proposal nothing is
fitted or added. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:long,end:long>"
FOUND = f"doc_id long, base array<{SPAN}>, proposed array<struct<kind:string,start:long,end:long,strict:boolean,key:string>>"

# The strict patterns, written so that a search takes time in proportion to the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT)\b")

# Wider patterns.
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,9}(?:\.[0-9]{1,9}){3,}")
SPELLED = re.compile(r"[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,8} ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[{] ?(?:dot|DOT|punkt|punto|point) ?[)\]}]) ?[A-Za-z0-9-]{1,63}){1,5}")
SPELLED_AT = re.compile(r"[(\[{] ?(?:at|AT|@) ?[)\]}]")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])")
GROUP = re.compile(r"[0-9]+")

# Gazetteers.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl be at ch eu us ca au jp br mx ar cl ru pl se no fi dk pt ie nz in cn biz me".split())
ISSUERS = re.compile(r"(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|35|6011|65|64[4-9]|62)")
COUNTRIES = re.compile(r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
RESERVED = re.compile(r"(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")
NEAR = {
    "email": frozenset("mail email e-mail correo courriel write contact kontakt contacto escribe schreiben address".split()),
    "ip": frozenset("ip host server address adresse dirección from login ping client router".split()),
    "card": frozenset("card visa mastercard amex credit debit carte tarjeta karte kreditkarte cc pan".split()),
    "phone": frozenset("tel phone call fax mobile cell telephone teléfono téléphone telefon handy móvil llame appelez anruf whatsapp contact kontakt".split()),
}
AGAINST = frozenset("version release isbn issn doi order invoice build revision commit hash sha md5 serial sku section chapter figure".split())
WORDS = re.compile(r"[^\W\d_][\w-]*")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @: the run of local characters before it that no match has taken, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, found.end() if found else 0))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def strict_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int]]]:
    """(base spans as (start, place of the kind, kind, end), matches that fail their test)."""
    base: list[tuple[str, int, int]] = [("email", *s) for s in emails(text)]
    failed: list[tuple[str, int, int]] = []
    for kind, pattern, test in (
        ("ip", IP, octets),
        ("card", CARD, lambda m: is_card(digits_of(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits_of(m)) <= 15),
    ):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            (base if test(m[0]) else failed).append((kind, *m.span()))
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]))), failed


def proposals(text: str, failed: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Wider candidates: parts of failed matches, spelled-out addresses, and telephone numbers with a bracket or a nought instead of a plus."""
    for kind, start, end in failed:
        groups = [m.span() for m in GROUP.finditer(text, start, end)]
        if kind == "card" and sum(b - a for a, b in groups) >= 12:
            for i, (low, _) in enumerate(groups):
                digits = ""
                for a, high in groups[i : i + 19]:
                    digits += text[a:high]
                    if len(digits) > 19:
                        break
                    if is_card(digits) or (low, high) in (groups[i], (start, end)) and len(digits) >= 12:
                        yield "card", low, high
        elif kind == "phone":
            digits = 0
            for a, high in groups:
                digits += high - a
                if digits > 15:
                    break
                if digits >= 9:
                    yield "phone", start, high
    for m in DOTTED.finditer(text):
        parts = [g.span() for g in GROUP.finditer(text, *m.span())]
        for i in range(len(parts) - 3):
            if octets(text[parts[i][0] : parts[i + 3][1]]):
                yield "ip", parts[i][0], parts[i + 3][1]
    if SPELLED_AT.search(text):
        for m in SPELLED.finditer(text):
            yield "email", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "phone", *m.span()


def side(char: str) -> str:
    """A character beside a span: nothing or a blank, a letter, a digit, a mark that joins, another."""
    return "_" if char == "" or char.isspace() else "a" if char.isalpha() else "0" if char.isdigit() else "-" if char in ".-_/@:+=" else "."


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One of + - ? of each labeler: pattern, validity, gazetteer, ends, words near, grouping, variety."""
    span, digits = text[start:end], digits_of(text[start:end])
    say = lambda yes, no=None: "+" if yes else "-" if no is None or no else "?"
    groups = [len(g) for g in GROUP.findall(span)]
    if kind == "email":
        ending = re.split(r"[.)\]} ]", span)[-1].lower()
        valid, known, grouped = 3 <= end - start <= 254 and ".." not in span, ending in ENDINGS, say(span[:1].isalnum(), False)
    elif kind == "ip":
        valid, known, grouped = octets(span), not RESERVED.match(span), say(not any(len(p) > 1 and p[0] == "0" for p in span.split(".")))
    elif kind == "card":
        valid, known, grouped = is_card(digits), bool(ISSUERS.match(digits)), say(groups in ([len(digits)], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3]))
    else:
        valid, known = 9 <= len(digits) <= 15, bool(COUNTRIES.match(digits)) if span[0] == "+" else span[0] in "(0"
        grouped = say(3 <= len(groups) <= 6 and min(groups[1:]) >= 2, len(groups) > 6 or min(groups) < 1)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    ends = say(side(before) in "_." and (side(after) in "_." or after in ".:" and side(text[end + 1 : end + 2]) == "_"))
    words = [w.lower() for w in WORDS.findall(text[max(0, start - 60) : start])[-3:] + WORDS.findall(text[end : end + 30])[:1]]
    near = "+" if any(w in NEAR[kind] for w in words) else "-" if any(w in AGAINST for w in words) else "?"
    varied = "?" if kind in ("email", "ip") else say(len(set(digits)) > 2 and digits not in "0123456789012345678901234567890", len(set(digits)) <= 2)
    return say(strict, False) + say(valid) + say(known) + ends + near + grouped + varied


def key_of(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """Kind, votes and features with few values: number of digits, kinds of characters beside the span, capital before it, lines."""
    digits = len(digits_of(text[start:end]))
    size = min(5, digits // 4) if kind != "email" else min(5, (end - start) // 8)
    around = side(text[max(0, start - 1) : start]) + side(text[end : end + 1])
    first = "n" if start == 0 or text[start - 1] == "\n" else "i"
    return f"{kind} {votes(text, kind, start, end, strict)} {size} {around} {first}"


def spans_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, bool, str]]]:
    """(base spans in order, all spans that labelers vote on)."""
    if not text or not ANY.search(text):
        return [], []
    base, failed = strict_spans(text)
    taken = set(base)
    more = sorted({p for p in proposals(text, failed) if p not in taken}, key=lambda s: (s[1], s[2], s[0]))
    free = Free(base)
    return base, [(*s, strict, key_of(text, *s, strict)) for strict, spans in ((True, base), (False, more)) for s in spans if strict or free.holds(*s[1:])]


class Free:
    """What spans leave free, in time that grows with the logarithm of their number."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = np.array(sorted(s[1] for s in spans), np.int64)
        self.ends = np.array(sorted(s[2] for s in spans), np.int64)

    def holds(self, start: int, end: int) -> bool:
        """Whether as many spans have ended at `start` as have begun before `end`."""
        return np.searchsorted(self.ends, start, "right") == np.searchsorted(self.starts, end, "left")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed) of each row of (doc_id, text); `proposed` has the base spans too, with what the labelers say."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    names = ("kind", "start", "end", "strict", "key")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t.as_py()) for t in batch["text"]]
            columns = [pa.array([[dict(zip(names, s, strict=False)) for s in f[k]] for f in found], pa.list_(pa.struct(list(zip(names[:n], kinds[:n], strict=True))))) for k, n in ((0, 3), (1, 5))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "base", "proposed"])

    return docs.mapInArrow(rows, FOUND)


def reliabilities(patterns: dict[str, float], rounds: int = 50) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of true spans, chances of each vote [labeler, false or true, vote], posterior of each pattern) by expectation-maximisation.

    Starts from the share of yes among a pattern's votes; one span of each kind of vote is added as a prior, two for votes that speak for the truth.
    """
    names = list(patterns)
    n = np.array([patterns[p] for p in names], float)
    vote = np.array([["-?+".index(c) for c in p] for p in names])
    yes, no = (vote == 2).sum(axis=1), (vote == 0).sum(axis=1)
    post = (yes + 1) / (yes + 2 * no + 2)
    hot = np.eye(3)[vote]
    prior = np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        chance = np.einsum("cp,plv->lcv", weight, hot) + prior
        chance /= chance.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        score = np.einsum("plv,lcv->pc", hot, np.log(chance)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(share), chance, dict(zip(names, post.tolist(), strict=True))


def classifier(counts: dict[str, int], ridge: float = 0.01, rounds: int = 30) -> dict[str, float]:
    """The chance that a span with each key is personal data, by a logistic model on the soft labels of the labelers' votes."""
    by_kind: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for key, n in counts.items():
        kind, said = key.split(" ")[:2]
        by_kind[kind][said] += n
    soft = {kind: reliabilities(dict(p))[2] for kind, p in by_kind.items()}
    out = {}
    for kind in soft:
        keys = sorted(k for k in counts if k.split(" ")[0] == kind)
        parts = [[f"{i}{c}" for i, c in enumerate(k.split(" ")[1])] + [f"f{i}{x}" for i, x in enumerate(k.split(" ")[2:])] for k in keys]
        number = {p: i for i, p in enumerate(sorted({p for row in parts for p in row}))}
        x = np.zeros((len(keys), len(number) + 1))
        x[:, -1] = 1
        for i, row in enumerate(parts):
            x[i, [number[p] for p in row]] = 1
        y = np.array([soft[kind][k.split(" ")[1]] for k in keys])
        n = np.array([counts[k] for k in keys], float)
        n /= n.sum()
        # Rare combinations count too: they are what is to be judged.
        n = 0.5 * n + 0.5 / len(n)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (p - y)) + ridge * w / len(keys)
            curve = (x.T * (n * p * (1 - p))) @ x + (ridge / len(keys) + 1e-9) * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        out |= dict(zip(keys, p.tolist(), strict=True))
    return out


def chosen(base: list[dict], proposed: list[dict], chance: dict[str, float], threshold: float) -> list[tuple[str, int, int, float]]:
    """The proposals to add: likely ones that overlap neither the base nor each other, the likeliest first."""
    rest = [(chance[s["key"]], s) for s in proposed if not s["strict"] and chance[s["key"]] >= threshold]
    rest.sort(key=lambda x: (-x[0], x[1]["start"] - x[1]["end"], x[1]["start"], KINDS.index(x[1]["kind"])))
    out: list[tuple[str, int, int, float]] = []
    taken: set[int] = set()
    for p, s in rest:
        own = range(s["start"], s["end"])
        if taken.isdisjoint(own):
            taken.update(own)
            out.append((s["kind"], s["start"], s["end"], p))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def personal_data(docs: DataFrame, text="text", doc_id="doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, added): the strict spans and those that the labelers' classifier adds, each with its chance."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(spans(slim), "spans")
    counts = {r["key"]: r["n"] for r in found.select(F.explode("proposed.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = classifier(counts)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [chosen(b, p, chance, threshold) for b, p in zip(batch["base"].to_pylist(), batch["proposed"].to_pylist(), strict=True)]
            column = pa.array([[dict(zip(("kind", "start", "end", "chance"), s, strict=True)) for s in a] for a in added], kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["base"], column], ["doc_id", "base", "added"])

    return found.mapInArrow(rows, f"doc_id long, base array<{SPAN}>, added array<struct<kind:string,start:long,end:long,chance:double>>")


def listed(spans_: str) -> str:
    """SQL for spans as kind:start:end, by start and then by kind."""
    place = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    return f"array_join(transform(array_sort(transform({spans_}, x -> struct(x.start AS s, {place} AS k, x.end AS e, x.kind AS kind))), y -> concat_ws(':', y.kind, y.s, y.e)), ',')"


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    numbers = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    both = "concat(base, transform(added, a -> struct(a.kind AS kind, a.start AS start, a.end AS end)))"
    return found.select("doc_id", *numbers, F.sha2(F.expr(listed("base")), 256).alias("base_sha256"), F.expr(listed(both)).alias("spans"), F.size("added").cast("long").alias("n_added"))
