"""URL filters: rules first, then a ratio of character language models.

Variable-order Markov models, smoothed by Witten-Bell interpolation down to a uniform byte, are fitted to accepted
and to rejected URLs; the difference of their log likelihoods per byte decides, against a threshold calibrated on
held-out hosts so that at most a given share of accepted URLs would go.

URLs are labelled by the rules that decide them, with the part that the rule names cut out, since that is what the
rules know already; and, where no rule fits, by fixed seed words in their host. A URL that a rule accepts on a host
that a seed word rejects has no clear label and teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm._io import discard, materialize, nth_values
from siltstone.llm._text import U, flatten, mix, pieces

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that mark a host as rejected or as accepted when models are fitted.
REJECTED = ("casino", "poker", "bet", "bets", "lottery", "jackpot", "pills", "pharma", "viagra", "adult", "porn", "xxx", "sex", "escort", "spam", "ads", "track", "tracker", "click", "loan", "payday", "replica", "warez", "crack", "cheap", "win", "free", "farm", "deals")
ACCEPTED = ("news", "daily", "library", "museum", "school", "garden", "music", "weather", "recipes", "travel", "science", "history", "journal", "review", "college", "health", "forum", "docs", "wiki", "art", "books", "city", "local", "nature", "theatre", "research")
#: A URL's full weight, a whole number, so that sums do not depend on their order.
FULL = 1 << 20


@dataclass(frozen=True)
class UrlRules:
    """``rules``: (allow or block, host/path prefix). The models count all different URLs; those of a host with more than
    ``urls`` weigh as much as so many together. ``order``: bytes of the longest context; ``most_false``: the share of held-out accepted
    URLs that may be blocked."""

    rules: tuple[tuple[str, str], ...] = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
    order: int = 5
    urls: int = 20
    most_false: float = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first by code point) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def contexts(data: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of context up to ``order``: the places of bytes that have one, and its hashes. A text's first
    byte begins it and is not predicted."""
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero(place > 0)
    h = np.full(len(at), U(0x9E3779B97F4A7C15))
    yield at, h
    for n in range(1, order + 1):
        some = place[at] >= n
        at = at[some]
        h = mix(h[some] * U(0xD1342543DE82EF95) + data[at - n].astype(U) + U(1))
        yield at, h


def with_byte(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(context ^ ((byte.astype(U) + U(1)) * U(0xA0761D6478BD642F)))


def lined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each between two line ends, and their bounds."""
    return np.frombuffer(b"".join(b"\n" + t + b"\n" for t in texts), np.uint8), np.append(0, np.cumsum([len(t) + 2 for t in texts], dtype=np.int64))


class MarkovModel:
    """Bytes given up to ``order`` bytes before them: counts of all contexts seen twice or more, by their hashes. A
    context's share for a byte is mixed with that of the next shorter one by the number of its different next bytes."""

    def __init__(self, texts: list[bytes], order: int):
        self.tables = []
        data, bounds = lined(texts)
        for n, (at, h) in enumerate(contexts(data, bounds, order)):
            pair, first, count = np.unique(with_byte(h, data[at]), return_index=True, return_counts=True)
            self._add(n, h[first], pair, count, count)

    @property
    def order(self) -> int:
        return len(self.tables) - 1

    @classmethod
    def of(cls, order: int, n: np.ndarray, context: np.ndarray, pair: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> MarkovModel:
        """From whole counts: length of context, its hash, the hash with the next byte, how often and with what weight."""
        model = cls.__new__(cls)
        model.tables = []
        for k in range(order + 1):
            at = np.flatnonzero(n == k)
            at = at[np.argsort(pair[at])]
            model._add(k, context[at], pair[at], seen[at], weight[at])
        return model

    def _add(self, n: int, context: np.ndarray, pair: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> None:
        keys, of = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(of, weight, len(keys)), np.bincount(of, minlength=len(keys))
        keep = (np.bincount(of, seen, len(keys)) >= 2) | (n == 0)
        self.tables.append((keys[keep], total[keep], kinds[keep], pair, weight))

    def logs(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each text's log likelihood."""
        p = np.full(len(data), 1 / 256)
        for (at, h), (keys, total, kinds, pair, count) in zip(contexts(data, bounds, self.order), self.tables, strict=True):
            if not len(keys) or not len(at):
                continue
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[k] == h
            at, h, k = at[known], h[known], k[known]
            own = with_byte(h, data[at])
            j = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            p[at] = (np.where(pair[j] == own, count[j], 0) + kinds[k] * p[at]) / (total[k] + kinds[k])
        logs = np.log(p)
        logs[bounds[:-1]] = 0
        return np.add.reduceat(logs, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


class UrlModel:
    """Models of accepted and rejected URLs, (host, text) each; ``cut`` and ``rates`` (accepted blocked, rejected
    blocked) come from hosts that were held out when they were fitted."""

    def __init__(self, accepted: list[tuple[str, bytes]], rejected: list[tuple[str, bytes]], rules: UrlRules):
        held = lambda host: crc32(host.encode()) % 4 == 0
        part = lambda some, side: [t for host, t in some if held(host) == side]
        fit = lambda *sides: tuple(MarkovModel(x, rules.order) for x in sides)
        self.models = fit(part(accepted, False), part(rejected, False))
        good, bad = (self.ratios(part(x, True)) for x in (accepted, rejected))
        place = int(np.ceil(len(good) * (1 - rules.most_false))) - 1
        self.cut = max(0.0, float(np.sort(good)[place])) if len(good) else 0.0
        self.rates = tuple(float((x > self.cut).mean()) if len(x) else 0.0 for x in (good, bad))
        self.models = fit([t for _, t in accepted], [t for _, t in rejected])

    @classmethod
    def of(cls, models: tuple[MarkovModel, MarkovModel], cut: float = 0.0, rates: tuple[float, float] = (0.0, 0.0)) -> UrlModel:
        model = cls.__new__(cls)
        model.models, model.cut, model.rates = models, cut, rates
        return model

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """Log likelihood of rejected over accepted, per byte."""
        data, bounds = lined(texts)
        return (self.models[1].logs(data, bounds) - self.models[0].logs(data, bounds)) / np.maximum(np.diff(bounds) - 1, 1)


def labelled_urls(urls: DataFrame, rules: UrlRules) -> DataFrame:
    """(host, text, bad) for the URLs of ``urls`` (host, path, rule, verdict) that have a clear label."""
    host, path, rule = F.col("host"), F.col("path"), F.col("rule")
    seeded = F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*map(F.lit, REJECTED)))
    # what is left of a URL without the rule's end of the host and start of the path
    name, prefix = F.split_part(rule, F.lit("/"), F.lit(1)), F.concat(F.lit("/"), F.regexp_extract(rule, r"^[^/]*/(.*)$", 1))
    left = F.concat(host.substr(F.lit(1), F.length(host) - F.length(name)), F.lit("/"), path.substr(F.length(prefix) + 1, F.length(path)))
    blocked = F.col("verdict") == "block"
    clear = F.when(rule.isNull(), True).otherwise(blocked | ~seeded)
    return urls.where((host != "") & clear).select("host", F.when(rule.isNull(), F.concat(host, path)).otherwise(left).alias("text"), F.coalesce(blocked, seeded).alias("bad"))


def seed_urls() -> list[tuple[str, str, bool]]:
    """(host, text, bad): hosts made of pairs of the seed words, so that neither class is empty."""
    out = []
    for bad, words in ((True, REJECTED), (False, ACCEPTED)):
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if a != b:
                    host = f"{('www.', '', 'm.', 'blog.')[(i + j) % 4]}{a}-{b}.example.{('com', 'net', 'org')[(i * 7 + j) % 3]}"
                    out.append((host, f"{host}/", bad))
    return out


def count_contexts(labels: DataFrame, order: int) -> DataFrame:
    """(bad, n, c, pair, seen, weight, seen_fit, weight_fit) over all of ``labels`` (text, bad, held, weight): how often
    a context and its next byte are met, and by hosts that are not held out. Contexts met once only are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            side = part["bad"].to_numpy(zero_copy_only=False) * 2 + part["held"].to_numpy(zero_copy_only=False)
            texts, weight = part["text"].cast(pa.large_binary()).to_pylist(), part["weight"].to_numpy()
            for k in np.unique(side).tolist():
                rows = np.flatnonzero(side == k)
                data, bounds = lined([texts[i] for i in rows])
                own = np.repeat(weight[rows], np.diff(bounds))
                for n, (at, h) in enumerate(contexts(data, bounds, order)):
                    pair, first, of, seen = np.unique(with_byte(h, data[at]), return_index=True, return_inverse=True, return_counts=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, of, own[at])
                    m = len(pair)
                    fit = 0 if k % 2 else 1
                    cols = [pa.array(np.full(m, k >= 2)), pa.array(np.full(m, n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(pair.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in (seen, total, seen * fit, total * fit))]
                    yield pa.RecordBatch.from_arrays(cols, names=["bad", "n", "c", "pair", *sums])

    sums = ["seen", "weight", "seen_fit", "weight_fit"]
    found = labels.mapInArrow(run, "bad boolean, n int, c long, pair long, seen long, weight long, seen_fit long, weight_fit long")
    table = found.groupBy("bad", "n", "c", "pair").agg(*(F.sum(x).alias(x) for x in sums))
    alone = (F.col("n") > 0) & (F.size("next") == 1) & (F.col("next")[0]["seen"] < 2)
    return table.groupBy("bad", "n", "c").agg(F.collect_list(F.struct("pair", *sums)).alias("next")).where(~alone).select("bad", "n", "c", F.inline("next"))


def fit_url_model(urls: DataFrame, rules: UrlRules = UrlRules()) -> UrlModel:
    """From ``urls`` (host, path, rule, verdict): all different URLs that have a label, and hosts made of the seed words.
    All are counted, and the threshold is found among all those of held-out hosts. No host outweighs others: see
    ``UrlRules.urls``. Contexts met twice or more come to the driver and to each task."""
    spark = urls.sparkSession
    labels = materialize(labelled_urls(urls, rules).union(spark.createDataFrame(seed_urls(), "host string, text string, bad boolean")).distinct(), "labels")
    hosts = labels.groupBy("host", "bad").agg(F.count("*").alias("k"))
    hosts = hosts.select("host", "bad", F.expr(f"greatest(1, {FULL} * {rules.urls} div greatest(k, {rules.urls}))").alias("weight"))
    hosts = F.broadcast(hosts) if hosts.count() <= 200_000 else hosts
    weighed = labels.join(hosts, ["host", "bad"]).select("text", "bad", (F.crc32("host") % 4 == 0).alias("held"), "weight")
    t = count_contexts(weighed, rules.order).toArrow()
    c = {k: t[k].to_numpy() for k in ("n", "bad", "seen", "weight", "seen_fit", "weight_fit")} | {k: t[k].to_numpy().view(U) for k in ("c", "pair")}

    def models(seen: str, weight: str) -> tuple[MarkovModel, MarkovModel]:
        some = [np.flatnonzero((c["bad"] == bad) & (c[seen] > 0)) for bad in (False, True)]
        return tuple(MarkovModel.of(rules.order, *(c[k][at] for k in ("n", "c", "pair", seen)), c[weight][at] / FULL) for at in some)

    shared = spark.sparkContext.broadcast(UrlModel.of(models("seen_fit", "weight_fit")))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part["bad"], pa.array(shared.value.ratios(part["text"].cast(pa.large_binary()).to_pylist()))], names=["bad", "ratio"])

    rated = materialize(weighed.where("held").select("bad", "text").mapInArrow(rate, "bad boolean, ratio double"), "rated")
    good = rated.where("not bad").select("ratio")
    size = good.count()
    cut = max(0.0, nth_values(good, [int(np.ceil(size * (1 - rules.most_false))) - 1])[0]) if size else 0.0
    over = {r["bad"]: r["r"] for r in rated.groupBy("bad").agg(F.avg((F.col("ratio") > cut).cast("int")).alias("r")).collect()}
    discard(labels, rated)
    return UrlModel.of(models("seen", "weight"), cut, (over.get(False, 0.0), over.get(True, 0.0)))


def judge_urls(pages: DataFrame, rules: UrlRules = UrlRules(), model: UrlModel | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for each row; ratio (rejected over accepted, log per byte)
    only where no rule fits.

    A null url, or one without ``://``, has empty host and path; an empty text is allowed. Of equally long rules that
    fit the first by code point counts, and a ratio equal to the threshold is allowed. URLs of any length are scored
    whole. Repeated rows are judged each; an empty table gives no rows; columns but page_id and url are not read.
    Rules are expressions in the plan, so their number must suit one.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules.rules)
    ruled = split.withColumns({"rule": rule, "verdict": verdict})
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_url_model(ruled, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in pieces((b.append_column("text", pc.binary_join_element_wise(b["host"], b["path"], "")) for b in batches), "text"):
            data, bounds = flatten(part["text"])
            raw, free = data.tobytes(), np.flatnonzero(part["verdict"].is_null().to_numpy(zero_copy_only=False) & (np.diff(bounds) > 0))
            ratio = np.full(part.num_rows, np.nan)
            if len(free):
                ratio[free] = model.ratios([raw[bounds[i] : bounds[i + 1]] for i in free])
            own = pa.array(np.where(ratio > model.cut, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([part["page_id"], part["host"], part["path"], part["rule"], pc.coalesce(part["verdict"], own), pa.array(ratio, mask=np.isnan(ratio))], names=["page_id", "host", "path", "rule", "verdict", "ratio"])

    return ruled.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, ratio double")
