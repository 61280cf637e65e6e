"""Matching: user agents, probes, gated rules over segments, and whole requests to log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import fixed
from ..functions.columns import let, sql_text
from ..functions.keywords import Gates
from ..functions.normalize import SEGMENT_BYTES
from ..functions.patterns import Rule, any_glob, custom_rules, default_rules, evasion_rules, glob_to_regex
from ..functions.checksums import passes
from ..functions.network import in_networks
from ..functions.scoring import attack_tool, score, score_label
from .redact import masked
from .segments import payload_text, with_segments
from .suppress import excluded

MATCH = "struct<ord:int,label:string,level:string,source:string,context:string>"


CONTEXTS = ("path", "query", "body", "headers")


def _match(ord_: int, label: str, level: str, source: str, context: str) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(label).alias("label"), F.lit(level).alias("level"), F.lit(source).alias("source"), F.lit(context).alias("context"))


def contains_any(low: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def open_gates(text: Column) -> Column:
    """Whether a segment holds anything that makes a scan worth while (screened), and the categories that it opens."""
    gates = Gates()
    mask = gates.masks(text)
    return F.struct(*(F.coalesce(gates.test(mask, g), F.lit(False)).alias(g) for g in ("screened", *fixed.CATEGORY_KEYWORDS)))


def flat_scan(text: Column, custom: list[Rule] | None = None, auth_path: Column | None = None, source: str = "middleware") -> Column:
    """Matches of default and custom rules in text as it is: no gates, no normalisation, no contexts."""
    custom = custom_rules()[0] if custom is None else custom

    def found(low: Column) -> Column:
        hits = [F.when(_holds(r, text, low), _match(k, r.label, r.level, source, "payload")) for k, r in enumerate(default_rules())]
        for k, r in enumerate(custom):
            hit = _holds(r, text, low) & (passes(r.validator, text, r.java) if r.validator else F.lit(True))
            if auth_path is not None and r.label in fixed.AUTH_SUPPRESSED:
                hit = hit & ~auth_path
            hits.append(F.when(hit, _match(1000 + k, r.label, r.level, "custom", "payload")))
        return F.array_compact(F.array(*hits))

    return let(F.lower(text), found)


def _holds(rule: Rule, text: Column, low: Column) -> Column:
    """Whether the rule matches; its expression only runs where the lower-cased text holds what every match holds."""
    return contains_any(low, list(rule.needs)) & text.rlike(rule.exists) if rule.needs else text.rlike(rule.exists)


def _capped(text: Column) -> Column:
    return F.when(F.octet_length(text) <= 8000, text).otherwise(F.substring(text.cast("binary"), 1, 8000).cast("string"))


def evasions(text: Column, context: str, source: str = "middleware") -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(r.exists), _match(k, r.label, r.level, source, context)) for k, r in enumerate(evasion_rules()))))


def _sql_match(ord_: int, r: Rule, source: str) -> str:
    return f"named_struct('ord', {ord_}, 'label', {sql_text(r.label)}, 'level', '{r.level}', 'source', {sql_text(source)}, 'context', s.context)"


def rule_gates(config: EngineConfig) -> Gates:
    """The bits of all that is asked of a text before an expression runs."""
    rules = [*evasion_rules(), *default_rules(), *custom_rules(config.custom_rules, config.validators)[0]]
    return Gates([r.needs for r in rules if r.needs])


def segment_matches(segments: str, config: EngineConfig, source: str = "middleware") -> Column:
    """Matches of decoded segments, one after the other, in order: evasions on the text as it came, default, custom rules.

    segments: the name of an array column of (context, raw, norm, raw_mask, norm_mask): a segment's first 8000 bytes, and
    what rule_gates says of it (Gates.segment).  auth_path is a column too.  All segments share one expression, since
    planning it costs more than running it over thousands of requests.
    """
    gates = rule_gates(config)
    gate = lambda r: f"g.screened AND g.{r.category} AND" if r.category in fixed.CATEGORY_KEYWORDS else ""
    case = lambda when, k, r, s: f"CASE WHEN {when} THEN {_sql_match(k, r, s)} END"
    test = lambda r, c: (f"{gates.sql(f's.{c}_mask', r.needs)} AND " if r.needs else "") + f"s.{c} RLIKE {sql_text(r.exists)}"
    found = [case(f"g.screened AND {test(r, 'raw')}", k, r, source) for k, r in enumerate(evasion_rules())]
    for k, r in enumerate(default_rules()):
        if config.mode != "relaxed" or r.level == "high":
            found.append(case(f"{gate(r)} {test(r, 'norm')}", 100 + k, r, source))
    custom = custom_rules(config.custom_rules, config.validators)[0]
    for k, r in enumerate(custom):
        own = f"s.context IN ({', '.join(map(sql_text, r.contexts))}) AND" if r.contexts else ""
        auth = "NOT auth_path AND" if r.label in fixed.AUTH_SUPPRESSED else ""
        found.append(case(f"{own} {gate(r)} {auth} {test(r, 'norm')}", 1000 + k, r, "custom"))
    opened = ", ".join([f"'screened', s.context = 'path' OR {gates.sql('s.raw_mask', 'screened')}", *(f"'{c}', {gates.sql('s.norm_mask', c)}" for c in fixed.CATEGORY_KEYWORDS)])
    matches = f"transform(array(named_struct({opened})), g -> array_compact(array({', '.join(found)})))[0]"
    one = f"CASE WHEN s.raw = '' OR s.raw IS NULL THEN CAST(array() AS array<{MATCH}>) ELSE {matches} END"
    checked = [r for r in custom if r.validator]
    if not checked:
        return F.expr(f"flatten(transform({segments}, s -> {one}))")
    out = F.expr(f"transform({segments}, s -> named_struct('norm', s.norm, 'matches', {one}))")

    def passed(s: Column) -> Column:
        left = s["matches"]
        for r in checked:
            left = F.filter(left, _passes(r, s["norm"]))
        return left

    return F.flatten(F.transform(out, passed))


def _passes(rule: Rule, norm: Column):
    return lambda m: (m["label"] != rule.label) | passes(rule.validator, norm, rule.java)


def pattern_matches(df: DataFrame, config: EngineConfig, source: str = "middleware", column: str = "pattern_matches") -> DataFrame:
    """Adds the matches of all segments, path, query, body, headers and raw in turn.  Needs segments and auth_path."""
    gates, segments = rule_gates(config), F.col("segments")
    held = {f"_{c}": gates.segment(segments[c]) for c in CONTEXTS} | {"_mask": gates.masks(segments["raw"], SEGMENT_BYTES)}
    decoded = F.array(*(F.struct(F.lit(c).alias("context"), _capped(segments[c]).alias("raw"), *(F.col(f"_{c}")[x].alias(x) for x in ("norm", "raw_mask", "norm_mask"))) for c in CONTEXTS))
    df = df.withColumns(held).withColumn("_segments", decoded).withColumn("_decoded", segment_matches("_segments", config, source))
    extra = F.filter(evasions(_capped(segments["raw"]), "raw", source), lambda m: ~F.exists("_decoded", lambda d: d["label"] == m["label"]))
    df = df.withColumn(column, F.concat("_decoded", F.when(gates.test(F.col("_mask"), "screened"), extra).otherwise(F.array().cast(f"array<{MATCH}>"))))
    if config.max_detections > 0:
        df = df.withColumn(column, F.slice(column, 1, config.max_detections))
    # a random column keeps later filters above the matching, which would else be planned and run once for each mention
    df = df.withColumn("_row", F.rand(0)).where("_row >= 0")
    return df.drop("_row", "_decoded", "_segments", *held)


def user_agent_matches(user_agent: Column) -> Column:
    """Signatures in a user agent.  A browser is only searched for automation markers, unless a known bot poses as one."""
    agent = F.coalesce(user_agent, F.lit("N/A"))
    low = F.lower(agent)
    full = [F.when(low.contains(s), _match(k, label, level, "user-agent", "user-agent")) for k, (s, label, level) in enumerate(fixed.USER_AGENTS)]
    empty = F.when(F.trim(agent).isin("", "0", "N/A", "-"), _match(900, "Empty User Agent", "low", "user-agent", "user-agent"))
    full = F.array_compact(F.array(*full, empty))
    headless = F.array_compact(F.array(*(F.when(low.contains(m), _match(k, f"{m.capitalize()} detected", "medium", "user-agent", "user-agent")) for k, m in enumerate(fixed.HEADLESS))))
    browser = low.contains("mozilla/") & low.contains("gecko")
    return F.when(browser & ~contains_any(low, fixed.SPOOFED), headless).otherwise(full)


def probe_label(path: Column, probes: tuple[tuple[str, str], ...] = tuple(fixed.PROBES)) -> Column:
    """The label of the probe that a path is, null for none: exact paths first, then globs in order."""
    low = F.lower(F.concat(F.lit("/"), F.ltrim(path, F.lit("/"))))
    exact = [x for p, label in probes if "*" not in p for x in (F.lit(p.lower()), F.lit(label))]
    globs = [F.when(low.rlike(glob_to_regex(p.lower())), label) for p, label in probes if "*" in p]
    looked = F.try_element_at(F.create_map(*exact), low) if exact else F.lit(None).cast("string")
    return F.coalesce(looked, *globs) if globs else looked


def admitted(requests: DataFrame, config: EngineConfig, environment: str = "production") -> DataFrame:
    """Requests that are looked at, with auth_path, content_path, api_route and probe."""
    if not config.runs_in(environment):
        return requests.where(F.lit(False)).withColumns({c: F.lit(False) for c in ("auth_path", "content_path", "api_route")}).withColumn("probe", F.lit(None).cast("string"))
    path = F.coalesce(F.nullif(F.trim("path", F.lit("/")), F.lit("")), F.lit("/"))
    out = requests.where(~in_networks(F.col("ip_address"), config.whitelist)) if config.whitelist else requests
    if config.only_paths:
        out = out.where(any_glob(path, config.only_paths))
    if config.skip_paths:
        out = out.where(~any_glob(path, config.skip_paths))
    api = F.concat(F.lit("/"), F.trim("path", F.lit("/")), F.lit("/")).contains("/api/")
    return out.withColumns({"auth_path": any_glob(path, config.auth_paths), "content_path": any_glob(path, config.content_paths), "api_route": api, "probe": probe_label(F.col("path"), config.probes)})


def analyse(requests: DataFrame, config: EngineConfig | None = None, source: str = "middleware", environment: str = "production") -> DataFrame:
    """One row per admitted request, with threats (all matches, probe and user agent first), confidence_score and label."""
    config = config or EngineConfig()
    df = with_segments(admitted(requests, config, environment), F.col("probe"), config.safe_fields, config.safe_paths)
    df = pattern_matches(df, config, source)
    probe = F.struct(F.lit(0).alias("ord"), F.col("probe").alias("label"), F.lit(config.probe_level).alias("level"), F.lit("probe").alias("source"), F.lit("path").alias("context"))
    empty = F.array().cast(f"array<{MATCH}>")
    df = df.withColumn("threats", F.concat(F.when(F.col("probe").isNotNull(), F.array(probe)).otherwise(empty), user_agent_matches(F.col("user_agent")), F.col("pattern_matches")))
    heavy = [c for c, w in config.context_weights.items() if w > 1]
    weighty = F.exists("pattern_matches", lambda m: m["context"].isin(heavy)) if heavy else F.lit(False)
    value = score(F.size("threats"), F.exists("threats", lambda m: m["level"] == "high"), weighty, attack_tool(F.col("user_agent")), config.mode_bonus)
    return df.withColumn("confidence_score", value).withColumn("confidence_label", score_label(F.col("confidence_score"))).drop("pattern_matches")


def log_rows(requests: DataFrame, config: EngineConfig | None = None, rules: DataFrame | None = None, source: str = "middleware", environment: str = "production") -> DataFrame:
    """Log rows of requests, batch or stream, before the de-duplication across requests (journal.request_log).

    Suppression in order: confidence, API routes, content paths, within a request each type once, exclusion rules.  All
    but the last is done within the request's row, so nothing is shuffled.
    """
    config = config or EngineConfig()
    df = analyse(requests, config, source, environment).where((F.size("threats") > 0) & (F.col("confidence_score") >= config.least_score))
    df = df.withColumn("_labels", F.array_distinct(F.transform("threats", lambda m: m["label"])))
    df = df.withColumn("payload", masked(payload_text(F.col("segments")), F.col("_labels"), config)).withColumn("stored_url", masked(F.col("url"), F.col("_labels"), config))
    typed = F.transform("threats", lambda m, i: F.struct(i.alias("pos"), m["level"].alias("level"), F.concat(F.lit("["), m["source"], F.lit("] "), m["label"]).alias("type")))
    api = lambda m: F.col("api_route") & m["level"].isin(list(config.api_suppress_levels))
    shown = F.filter(typed, lambda m: ~api(m) & (~F.col("content_path") | (m["level"] == "high")))
    once = let(shown, lambda all_: F.filter(all_, lambda m, i: F.array_position(F.transform(all_, lambda x: x["type"]), m["type"]) == i + 1))
    df = df.select("request_id", "ts", "ip_address", F.col("stored_url").alias("url"), "user_agent", "user_id", "payload", "confidence_score", "confidence_label", F.explode(once).alias("m"))
    out = df.select(
        "request_id", F.col("ts").alias("created_at"), "ip_address", "url", "user_agent", "m.type", "payload", F.col("m.level").alias("threat_level"), "confidence_score", "confidence_label",
        F.lit(False).alias("is_false_positive"), F.lit("logged").alias("action_taken"), "user_id", "m.pos",
    )
    return out if rules is None else excluded(out, rules)
