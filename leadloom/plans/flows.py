"""Composite flows: hand-off tables, validation per file, carried identifiers, feedback, gates over many inputs, convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedupe, rank
from ..session import computed

# Headers of lead files and the columns that they stand for.
HEADERS = {
    "店舗名": "store_name", "URL": "url", "元のURL": "url", "コメント": "comment", "スコア": "score", "点数": "score", "地方": "region", "市区町村": "city", "業種": "business_type", "サイト種別": "site_type",
    "電話番号": "phone", "メール": "email", "検索クエリ": "source_query", "取得日時": "fetched_at_iso", "判定": "grade", "判定理由": "reasons", "HTTPステータス": "http_status", "最終URL": "final_url", "生存": "is_alive",
    "チェック日時": "checked_at_iso",
}


def with_headers(df: DataFrame, headers: dict[str, str] = HEADERS, fallbacks: Sequence[str] = ("Website URL", "website")) -> DataFrame:
    """Columns under their lasting names, of several for one name the first filled one; ``url`` falls back to other columns, ``score`` becomes an integer or 0."""
    names = list(dict.fromkeys(headers.get(c, c) for c in df.columns))
    filled = lambda c: F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`"))
    of = {n: [c for c in df.columns if headers.get(c, c) == n] for n in names}
    out = {n: F.col(f"`{cs[0]}`") if len(cs) == 1 else F.coalesce(*map(filled, cs)) for n, cs in of.items()}
    more = [c for c in fallbacks if c in df.columns]
    if more or "url" not in out:
        out["url"] = F.coalesce(*[filled(c) for c in of.get("url", [])], *map(filled, more), F.lit(""))
    if "score" in out:
        out["score"] = F.coalesce(text.whole_number(out["score"]), F.lit(0)).try_cast("int")
    return df.select(*[c.alias(n) for n, c in out.items()])


def handoff(df: DataFrame, aliases: dict[str, Sequence[str]], row: Column, source: str) -> DataFrame:
    """Rows of any header spelling in the columns of ``aliases`` with ``lead_id``, ``domain``, ``source_csv`` and ``source_row``; every column of the input follows under its name with ``original__``.

    The domain is the first usable one of ``domain``, ``website`` and ``contact_url``; a row without identifier gets one of its domain, else of its name and number.
    """
    # picked and told once each, as later columns use them again and again
    held = computed(df, {f"_in_{n}": text.pick(df, a) for n, a in aliases.items()} | {"_row": row.cast("bigint")})
    get = lambda n: F.col(f"_in_{n}") if n in aliases else F.lit("")
    held = computed(held, {"_domain": urls.first_domain(get("domain"), get("website"), get("contact_url"))})
    held = computed(held, {"_name": F.coalesce(F.when(get("business_name") != "", get("business_name")), F.col("_domain"))})
    ident = F.when(get("lead_id") != "", get("lead_id")).otherwise(urls.lead_id(F.col("_domain"), F.col("_name"), F.col("_row")))
    made = {"lead_id": ident, "business_name": F.col("_name"), "domain": F.col("_domain"), **{n: get(n) for n in aliases if n not in ("lead_id", "business_name", "domain")}}
    base = [c.alias(n) for n, c in made.items()] + [F.lit(source).alias("source_csv"), F.col("_row").cast("string").alias("source_row")]
    original = [F.coalesce(urls.strip(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"original__{c.replace(chr(0xFEFF), '').strip()}") for c in df.columns if c.replace("﻿", "").strip()]
    return held.select(*base, *original)


def validated(leads: DataFrame, checks: DataFrame, file: str, keep_dead: bool = False) -> DataFrame:
    """Leads of many files with liveness and status, one of each domain of the final address in each file, the best by score.

    ``leads`` has ``seq, url, score``, ``checks`` one row for each ``url`` with ``status`` and ``final_url``; an address that wasn't checked is dead.
    """
    from ..operators.classify import alive

    out = leads.join(checks.select("url", F.col("status").alias("http_status"), "final_url"), "url", "left")
    out = out.withColumn("is_alive", alive(F.col("http_status"))).withColumn("status", F.when(F.col("is_alive"), "OK").otherwise("DEAD"))
    kept = out if keep_dead else out.where("is_alive")
    domain = urls.domain_key(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
    return dedupe.keep_best(kept, [F.col(file), domain], F.col("score"), F.col("seq"), drop_blank=True)


def validation_totals(leads: DataFrame, checks: DataFrame, file: str) -> DataFrame:
    """Total, alive, dead and unique leads of each file, and of all files under a null file."""
    from ..operators.classify import alive

    seen = leads.join(checks.select("url", F.col("status").alias("http_status")), "url", "left").withColumn("is_alive", alive(F.col("http_status")))
    counts = seen.groupBy(file).agg(F.count("*").alias("total"), F.count_if("is_alive").alias("alive"), F.count_if(~F.col("is_alive")).alias("dead"))
    unique = validated(leads, checks, file).groupBy(F.col(file).alias("_file")).agg(F.count("*").alias("unique"))
    both = counts.join(unique, F.col(file).eqNullSafe(F.col("_file")), "left").drop("_file").fillna({"unique": 0})
    total = both.agg(*[F.sum(c).alias(c) for c in ("total", "alive", "dead", "unique")])
    return both.unionByName(total.withColumn(file, F.lit(None).cast(dict(both.dtypes)[file])))


def region_run(leads: DataFrame, checks: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of a region: live leads (as in ``validated``), the best of each domain over all, in order of ``label`` (``labels`` by ``seq``), score and appearance, with ``position``."""
    own = validated(leads.withColumn("_one", F.lit(1)), checks, "_one").drop("_one").join(labels, "seq")
    listed = own.withColumn("domain", urls.domain_key(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))))
    return rank.positions(listed, [rank.label_order(F.col("label")).desc(), F.desc("score"), F.col("seq")])


def carried_ids(collected: DataFrame, existing: DataFrame, least: int = 40, start: int = 3000, width: int = 5) -> DataFrame:
    """The best row of each address with its identifier: the one it had, else a new number after the largest, in order of score and first appearance.

    ``collected`` has ``seq, url, score``, ``existing`` ``id, url``; rows below ``least`` or without address are dropped.
    """
    best = dedupe.keep_position(collected.where((F.col("score") >= least) & (urls.strip(F.col("url")) != "")), urls.strip(F.col("url")), F.col("score"), F.col("seq"))
    known = existing.where("id is not null and id <> ''").groupBy(urls.strip(F.col("url")).alias("_url")).agg(F.max_by("id", "id").alias("_id"))
    joined = best.withColumn("_key", urls.strip(F.col("url"))).join(known, F.col("_key") == F.col("_url"), "left").drop("_url", "_key")
    fresh = rank.next_ids(joined.where("_id is null"), existing, "id", [F.desc("score"), F.col("position")], start, width).withColumnRenamed("new_id", "id")
    full = F.when(F.col("_id").rlike("^[0-9]+$") & (F.length("_id") < width), F.lpad("_id", width, "0")).otherwise(F.col("_id"))
    return joined.where("_id is not null").withColumn("id", full).unionByName(fresh).drop("_id")


def outcome(status: Column, reason: Column) -> Column:
    """Struct ``outcome, sent_status, skip_reason, error_reason`` of a status and its reason."""
    s, r = F.lower(urls.strip(F.coalesce(status, F.lit("")))), F.lower(urls.strip(F.coalesce(reason, F.lit(""))))
    said = F.coalesce(F.when(reason != "", reason), status, F.lit(""))
    failed = (s == "failed") | F.contains(s, F.lit("error")) | r.startswith("exception")
    kind = F.when(s == "sent", "sent").when(s.startswith("prepared"), "prepared").when(s.startswith("skipped"), "skipped").when(failed, "failed").otherwise("unknown")
    return urls.let(kind, lambda k: F.struct(
        k.alias("outcome"), F.when(k == "sent", "sent").otherwise("").alias("sent_status"), F.when(k == "skipped", said).otherwise("").alias("skip_reason"), F.when(k == "failed", said).otherwise("").alias("error_reason"),
    ))


def outcomes(leads: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Feedback rows of leads (``lead_id, status, reason``): their outcome by the ledger (the last row of each ``lead_id`` by ``seq``), else by themselves, and where it comes from."""
    last = dedupe.keep_latest(ledger.where("lead_id is not null"), [F.col("lead_id")], F.lit(None).cast("timestamp"), F.col("seq"))
    both = leads.join(last.select("lead_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"), F.lit(True).alias("_held")), "lead_id", "left")
    pick = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.when(F.col(b) != "", F.col(b)), F.lit(""))
    made = both.select("lead_id", pick("_status", "status").alias("status"), pick("_reason", "reason").alias("reason"), F.coalesce("_held", F.lit(False)).alias("held"))
    source = F.when(F.col("held"), "ledger").when((F.col("status") != "") | (F.col("reason") != ""), "handoff_status").otherwise("unknown")
    return made.select(F.lit(run_id).alias("run_id"), "lead_id", outcome(F.col("status"), F.col("reason")).alias("o"), source.alias("outcome_source")).select("run_id", "lead_id", "o.*", "outcome_source")


def written_names(df: DataFrame, name: Column, targets: Sequence[str], review: Column) -> DataFrame:
    """The cleaned name in all its columns, where it is filled, and whether the row needs a review."""
    held = df.withColumn("_name", name)
    put = {t: F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col(t) if t in df.columns else F.lit("")) for t in targets}
    return held.withColumns(put | {"needs_review": F.coalesce(review, F.lit(False))}).drop("_name")


def validation_gates(leads: DataFrame, by: str, kept: Column, counts: dict[str, Column], rates: dict[str, tuple[str, str]], checks: dict[str, Column]) -> DataFrame:
    """Gates over many inputs in one pass: for each value of ``by`` the rates over all its rows (``b_<rate>``) and over the kept ones (``a_<rate>``), each check, ``passed`` and the failed ones."""
    from ..operators.aggregate import gates

    ok = F.coalesce(kept, F.lit(False))
    both = leads.groupBy(by).agg(*[F.count_if(F.coalesce(c, F.lit(False)) & on).alias(f"{p}_{n}") for n, c in counts.items() for p, on in (("b", F.lit(True)), ("a", ok))])
    both = both.withColumns({f"{p}_{n}": text.ratio(F.col(f"{p}_{a}"), F.col(f"{p}_{b}")) for n, (a, b) in rates.items() for p in "ba"})
    return gates(both, checks)


def change_warnings(before: Column, after: Column, drop: float = 0.12, rise: float = 0.12, alone: float = 0.12) -> Column:
    """Names of suspicious changes between two structs of rates: the unknown rate falls while the corporate one rises, or the solo rate rises sharply."""
    fell = before["unknown_rate"] - after["unknown_rate"]
    more, solo = after["corporate_rate"] - before["corporate_rate"], after["solo_rate"] - before["solo_rate"]
    return F.array_compact(F.array(F.when((fell >= drop) & (more >= rise), F.lit("unknown_to_corporate")), F.when(solo >= alone, F.lit("solo_jump"))))


def convergence(loops: DataFrame, worst: int = 3) -> DataFrame:
    """One row for each ``run``: the loop that counts (the best improved one, else the first that passed, else the last), the change of ``theta``, regressions, and whether it is among the ``worst`` runs by that change.

    ``loops`` has ``run, loop, before, after, improved, passed``.
    """
    order = [F.when(F.col("improved"), 0).when(F.col("passed"), 1).otherwise(2), F.when(F.col("improved"), -F.col("after")), F.when(F.col("improved") | F.col("passed"), F.col("loop")).otherwise(-F.col("loop"))]
    chosen = dedupe.keep_first(loops, [F.col("run")], order)
    passed = loops.groupBy(F.col("run").alias("_run")).agg(F.max("passed").alias("any_passed"))
    out = chosen.join(passed, F.col("run") == F.col("_run")).withColumn("delta", F.col("after") - F.col("before"))
    flags = F.array_compact(F.array(F.when(~F.col("any_passed"), F.lit("gate_failed")), F.when(F.col("delta") < 0, F.lit("theta_degraded")), F.when(~F.col("improved"), F.lit("theta_not_improved"))))
    out = out.select("run", "loop", "delta", F.col("any_passed").alias("passed"), flags.alias("regressions"))
    low = out.orderBy(F.col("delta").asc_nulls_last(), "run").limit(worst).select(F.col("run").alias("_run"), F.lit(True).alias("worst"))
    return out.join(low, F.col("run") == F.col("_run"), "left").drop("_run").withColumn("worst", F.coalesce("worst", F.lit(False)))


#: Verdicts of a model that are no reason to drop a lead unless one of these flags says more.
HARD_FLAGS = ("PORTAL", "CORPORATE", "FOREIGN", "JOB")


def model_verdicts(leads: DataFrame, responses: DataFrame, hard: Sequence[str] = HARD_FLAGS, least: int = 60) -> DataFrame:
    """Leads with the verdict of a model, out of a table of its raw answers by ``url``: ``action, category, flags, confidence``.

    A lead is dropped only by an answer that says DROP with at least ``least`` confidence and one of the
    ``hard`` flags; a missing or unreadable answer keeps it.
    """
    shape = "action string, category string, flags array<string>, confidence int"
    read = F.from_json(text.json_object(F.col("answer")), shape)
    one = responses.groupBy("url").agg(F.min("answer").alias("answer"))
    out = leads.join(one, "url", "left").withColumn("_v", read)
    flags = F.coalesce("_v.flags", F.array().cast("array<string>"))
    drop = (F.upper("_v.action") == "DROP") & (F.col("_v.confidence") >= least) & F.arrays_overlap(flags, F.array(*[F.lit(h) for h in hard]))
    return out.withColumns({"action": F.when(drop, "DROP").otherwise("KEEP"), "category": F.coalesce("_v.category", F.lit("none")), "flags": flags, "confidence": F.coalesce("_v.confidence", F.lit(0))}).drop("_v", "answer")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Counts of the verdicts by action, category and flag: ``kind, value, n, confidence`` (rounded average)."""
    items = F.array(F.struct(F.lit("action").alias("kind"), F.col("action").alias("value")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")))
    flags = F.transform("flags", lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("value")))
    each = verdicts.select("confidence", F.inline(F.concat(items, flags)))
    return each.groupBy("kind", "value").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 1).alias("confidence"))
