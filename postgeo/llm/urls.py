"""URL filter: rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words

DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
#: The labelled URLs, as host and path. They name kinds of sites, no site of a given
#: table; both lists have the same endings, prefixes and kinds of paths.
BLOCKED = [
    ("casino-royal.example.com", "/play"), ("www.online-casino.example.org", "/en/"), ("casino.bonus-play.example.net", "/"),
    ("m.best-casinos.test", "/de/4"), ("sports-bets.info", "/odds"), ("blog.betting-tips.example.com", "/fr/9"),
    ("bet-now.example.org", "/"), ("livebet.example.net", "/football"), ("www.poker-room.test", "/en/5"), ("slots-jackpot.info", "/spin"),
    ("m.lottery-prize.example.com", "/winner"), ("roulette-bonus.example.org", "/deposit"), ("blog.buy-pills-online.example.net", "/"),
    ("discount-viagra.test", "/order"), ("pharmacy-discount.info", "/pills"), ("www.cheap-meds.example.com", "/"),
    ("weightloss-pills.example.org", "/fr/3"), ("m.no-prescription-drugs.example.net", "/cart"), ("cheapest-pharma.test", "/en/"),
    ("blog.steroids-shop.info", "/"), ("adult-video.example.com", "/"), ("xxx-tube.example.org", "/watch"),
    ("www.hot-porn.example.net", "/de/8"), ("sex-cams.test", "/live"), ("m.adult-dating.info", "/en/"),
    ("nude-pics.example.com", "/gallery"), ("blog.escorts-city.example.org", "/"), ("adults-only.example.net", "/enter"),
    ("track.ads-server.test", "/pixel"), ("www.adserver.info", "/banner"), ("click-tracker.example.com", "/en/1"),
    ("m.popup-ads.example.org", "/"), ("banner-ads.example.net", "/fr/2"), ("blog.tracking-pixel.test", "/p"), ("ad-network.info", "/"),
    ("ads.tracker.example.com", "/collect"), ("www.link-farm.example.org", "/"), ("seo-spam.example.net", "/en/4"),
    ("m.spam-links.test", "/de/"), ("backlinks-farm.info", "/buy"), ("blog.free-download-crack.example.com", "/"),
    ("warez-crack.example.org", "/keygen"), ("torrent-crack.example.net", "/en/"), ("www.win-free-prize.test", "/"),
    ("free-money-win.info", "/es/2"), ("m.payday-loans.example.com", "/apply"), ("quick-loan-cash.example.org", "/"),
    ("blog.replica-watches.example.net", "/buy"), ("malware-host.test", "/exe"), ("phish-login.info", "/bank"),
    ("www.crypto-giveaway.example.com", "/"), ("free-giftcards.example.org", "/claim"),
]
ALLOWED = [
    ("harbour.example.com", "/"), ("www.orchard.example.org", "/en/453"), ("blog.example.net", "/2021/05/garden"),
    ("m.meadow.test", "/de/252.html"), ("news.info", "/world/article-17.html"), ("blog.university.example.com", "/faculty/physics"),
    ("library.example.org", "/catalogue"), ("city-council.example.net", "/services/"), ("www.museum.test", "/exhibition/3"),
    ("docs.info", "/guide/install.html"), ("m.recipes.example.com", "/soup"), ("weather.example.org", "/fr/"),
    ("blog.school.example.net", "/timetable"), ("music.test", "/en/albums"), ("shop.info", "/es/883"),
    ("www.books.example.com", "/fiction/"), ("travel.example.org", "/de/trains"), ("m.forum.example.net", "/topic/8"),
    ("science.test", "/paper/129"), ("blog.health.info", "/en/sleep"), ("gardening.example.com", "/en/625.html"),
    ("history.example.org", "/fr/825"), ("www.theatre.example.net", "/programme"), ("the-other-side.test", "/en/31/"),
    ("m.northern-line.info", "/stations"), ("nation.example.com", "/de/7"), ("blog.education.example.org", "/en/125/"),
    ("fishing.example.net", "/fr/748"), ("relations.test", "/en/27"), ("www.anderes.info", "/en/9"), ("lichtung.example.com", "/de/14"),
    ("m.ouverte.example.org", "/fr/55"), ("ciudad.example.net", "/es/102"), ("blog.railway.test", "/timetable"),
    ("astronomy.info", "/en/stars"), ("painting.example.com", "/fr/"), ("www.football.example.org", "/en/results"),
    ("chess.example.net", "/en/openings"), ("m.parliament.test", "/minutes"), ("weaving.info", "/patterns"),
    ("blog.bakery.example.com", "/bread"), ("cycling.example.org", "/routes"), ("bike-shop.example.net", "/repair"),
    ("www.wool.test", "/shop/"), ("meadow.info", "/"), ("m.track-and-field.example.com", "/en/results"),
    ("advice.example.org", "/citizens"), ("blog.freedom.example.net", "/essay"), ("winter.test", "/ski"), ("essex.info", "/towns"),
    ("www.farm-museum.example.com", "/visit"), ("linked-data.example.org", "/en/"),
]
#: Production rules: host and path, and what they say.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(url, F.lit("")), "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits host (or a parent domain) and the start of the path; else null."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, start = rule.partition("/")
        under = (host == domain) | host.endswith("." + domain)
        fits = F.when(under & path.startswith("/" + start), F.lit(rule)).otherwise(fits)
    return fits


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the distinct places of the n-grams of every row's host and path, which are
    told apart. Whole lists at once: n-grams are bytes side by side in one buffer."""
    parts = [f"^{h}$".encode() for h in hosts] + [f"^{p}$".encode() for p in paths]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    code = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # bytes up to the part's end
    keys = []
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        gram = gram[: len(code) - n + 1] << np.uint64(8) | code[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(left[: len(gram)] >= n)
            mark = (part[at] >= len(hosts)).astype(np.uint64) << np.uint64(3) | np.uint64(n)
            place = words.mix(gram[at] << np.uint64(8) | mark) % np.uint64(DIMENSIONS)
            keys.append((part[at] % len(hosts)).astype(np.int64) * DIMENSIONS + place.astype(np.int64))
    both = np.unique(np.concatenate(keys)) if len(parts) else np.zeros(0, np.int64)
    return both // DIMENSIONS, both % DIMENSIONS


def scores(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    """Chance of each address that its page is unwanted."""
    row, place = _features(hosts, paths)
    many = np.maximum(1, np.bincount(row, minlength=len(hosts)))
    z = np.bincount(row, weights=weights[place], minlength=len(hosts)) / np.sqrt(many) + weights[-1]
    return 1 / (1 + np.exp(-z))


def fit(blocked: list[tuple[str, str]], allowed: list[tuple[str, str]], rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) by gradient descent on the whole small table."""
    hosts, paths = zip(*[*blocked, *allowed])
    owner, place = _features(list(hosts), list(paths))
    want = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    value, w = 1 / np.sqrt(np.bincount(owner))[owner], np.zeros(DIMENSIONS + 1)
    for _ in range(rounds):
        z = np.bincount(owner, weights=value * w[place], minlength=len(want)) + w[-1]
        miss = 1 / (1 + np.exp(-z)) - want
        w[:-1] -= 2.0 * (np.bincount(place, weights=value * miss[owner], minlength=DIMENSIONS) / len(want) * 10 + l2 * w[:-1])
        w[-1] -= 0.5 * miss.mean()
    return w


def judge(
    pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES,
    blocked: list[tuple[str, str]] = BLOCKED, allowed: list[tuple[str, str]] = ALLOWED, threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, score (chance that the page is unwanted) and verdict.

    The longest fitting rule decides; without one the score does. A null, empty or odd
    address has empty host and path, fits no rule, and is judged on its empty parts.
    Columns of ``pages`` with the names of new ones are replaced; repeated rows repeat;
    an empty table stays empty.
    """
    weights = fit(blocked, allowed)
    host, path = url_parts(F.col(url_col))
    new = ["host", "path", "rule", "score", "verdict"]
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in new or c == url_col])
    rows = rows.withColumn("_host", host).withColumn("_path", path)
    boxed = rows.select("_host", "_path", F.struct("*").alias("_row"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = scores(batch.column(0).to_pylist(), batch.column(1).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(chance, pa.float64())], ["_row", "score"])

    scored = boxed.mapInArrow(score, f"_row {boxed.schema['_row'].dataType.simpleString()}, score double")
    says = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None)
    return (
        scored.select("_row.*", "score")
        .withColumn("rule", rule_of(F.col("_host"), F.col("_path"), [r for r, _ in rules]))
        .withColumn("verdict", F.coalesce(says[F.col("rule")] if rules else F.lit(None).cast("string"),
                                          F.when(F.col("score") >= threshold, "block").otherwise("allow")))
        .withColumnsRenamed({"_host": "host", "_path": "path"})
    )
