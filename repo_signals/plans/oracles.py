"""The SQL twins of the named queries, for DuckDB over the same Parquet tables.

They state the result in the plainest SQL; nothing here is run by Spark.
"""

from __future__ import annotations

from repo_signals import schema
from repo_signals.functions.columns import WHITESPACE
from repo_signals.plans.catalogue import CUTOFF, LANGUAGE_OF, MODEL_COLUMNS, PART_TOPICS, SEGMENT_CODES, strength_columns

REPOS = """
with l as (
  select l_orderkey, sum(l_quantity) q, count(*) n,
         sum(case when l_returnflag='R' then 1 else 0 end) r,
         max(l_shipdate) ing, min(l_partkey) pk
  from lineitem group by l_orderkey),
repos as (
  select o_orderkey as id, p_name as name, concat(c_name,'/',p_name) as full_name,
         c_name as owner_login, nullif(c_mktsegment,'HOUSEHOLD') as language,
         cast(q as bigint) as stargazers_count, cast(q as bigint) as watchers_count,
         cast(n as bigint) as forks_count, cast(r as bigint) as open_issues_count,
         cast(floor(o_totalprice) as bigint) as size,
         o_orderdate as created_at, ing as ingested_at
  from orders join l on l_orderkey=o_orderkey
  join customer on c_custkey=o_custkey join part on p_partkey=pk)
"""

DAY = 86400000000


def r6(x: str) -> str:
    """Six decimals, by the same arithmetic as the queries; numbers too large for that pass as they are."""
    return f"(list_transform([({x})], lambda v: case when abs(v) < 9007199254740992 / 1e6 then floor(v * 1e6 + 0.5e0) / 1e6 else v end)[1])"


def days(a: str, b: str) -> str:
    return f"cast(floor((epoch_us({a}) - epoch_us({b})) / {DAY}) as bigint)"


def corr(x: str, y: str) -> str:
    """NULL for a constant column."""
    both = f"filter (where {x} is not null and {y} is not null)"
    spread = f"(stddev_pop({x}) {both} * stddev_pop({y}) {both})"
    return f"(case when {spread} > 0 then covar_pop({y}, {x}) / {spread} end)"


def num(column: str) -> str:
    return f"cast({column} as double)"


PRE = (
    REPOS
    + f""", pre as (
  select id, name, full_name, owner_login, coalesce(language, 'Unknown') as language,
         stargazers_count, watchers_count, forks_count, open_issues_count, size, created_at, ingested_at,
         {days('ingested_at', 'created_at')} as age_days, ln(1 + stargazers_count) as log_stars
  from repos)
"""
)

ORG = "|".join(schema.ORG_KEYWORDS)

OWNERS = f"""
owners as (
  select owner_login,
         avg(stargazers_count) as owner_mean_stars,
         cast(sum(stargazers_count) as bigint) as owner_total_stars,
         count(*) as owner_repo_count,
         stddev_samp(stargazers_count) as owner_std_stars,
         avg(forks_count) as owner_mean_forks,
         cast(sum(forks_count) as bigint) as owner_total_forks,
         min(created_at) as owner_first_repo,
         max(created_at) as owner_last_repo,
         avg(case when stargazers_count > 100 then 1e0 else 0e0 end) as owner_success_rate,
         {days('(select max(ingested_at) from repos)', 'min(created_at)')} as owner_tenure_days,
         {days('max(created_at)', 'min(created_at)')} as owner_active_days,
         case when regexp_matches(lower(owner_login), '{ORG}') or count(*) > 100 then 1 else 0 end as owner_is_org
  from repos group by owner_login)
"""

MEASURES = ", ".join(f"coalesce({num('o.' + c)}, (select median({c}) from raw)) as {c}" for c in schema.OWNER_MEASURES)
LOGS = ", ".join(f"ln(1 + {c}) as log_{c}" for c in schema.OWNER_LOGGED)

JOINED = (
    PRE
    + ", "
    + OWNERS
    + f""", raw as (select p.*, o.* exclude (owner_login) from pre p left join owners o on p.owner_login = o.owner_login),
filled as (
  select o.* exclude ({', '.join(schema.OWNER_MEASURES)}, owner_is_org), coalesce(o.owner_is_org, 0) as owner_is_org, {MEASURES}
  from raw o),
own as (select *, {LOGS} from filled)
"""
)


def topic_columns(text: str, topics: dict[str, list[str]], regex: bool) -> str:
    hits = []
    for topic, words in topics.items():
        if regex:
            test = f"regexp_matches({text}, '{'|'.join(words)}')"
        else:
            test = " or ".join(f"contains({text}, '{w}')" for w in words)
        hits.append(f"case when {test} then 1 else 0 end as {topic}")
    return ", ".join(hits)


def topic_sum(topics: dict[str, list[str]]) -> str:
    return "cast(" + " + ".join(topics) + " as integer) as topic_count"


# An unknown age stays unknown, which greatest() would skip.
SAFE_AGE = "(case when age_days < 1 then 1 else age_days end)"

VELOCITY = f"""
{SAFE_AGE} as age_days_safe,
stargazers_count / {SAFE_AGE} as stars_per_day,
forks_count / {SAFE_AGE} as forks_per_day,
open_issues_count / {SAFE_AGE} as issues_per_day,
forks_count / (stargazers_count + 1) as fork_to_star_ratio,
open_issues_count / (stargazers_count + 1) as issue_to_star_ratio,
ln(1 + stargazers_count / {SAFE_AGE}) as log_stars_per_day,
ln(1 + forks_count / {SAFE_AGE}) as log_forks_per_day,
ln(1 + open_issues_count / {SAFE_AGE}) as log_issues_per_day
"""

ENRICHED = (
    JOINED
    + f""", topical as (
  select *, {topic_columns("lower(name || ' ' || full_name)", schema.TOPIC_PATTERNS, True)} from own),
enriched as (select *, {topic_sum(schema.TOPIC_PATTERNS)}, {VELOCITY} from topical)
"""
)

BLOCKS = """, numbered as (
  select *, row_number() over (order by ingested_at, id) - 1 as ri, count(*) over () as nn from {source}),
blk as (
  select *, case when ri < nn - 3 * (nn // 4) then 0 else (ri - (nn - 3 * (nn // 4))) // (nn // 4) + 1 end as block
  from numbered)
"""

DOUBLES = {
    "age_days": False,
    "forks_count": False,
    "open_issues_count": False,
    "size": False,
    "language": False,
    "owner_is_org": False,
    **{t: False for t in schema.TOPIC_FEATURES},
}


def listed(columns: list[str], prefix: str = "") -> str:
    """A select list in which double columns are rounded."""
    return ", ".join(
        f"{prefix}{c} as {c}" if c in DOUBLES else f"{r6(num(prefix + c))} as {c}" for c in columns
    )


def struct_rows(parts: list[tuple[str, str]]) -> str:
    return " union all ".join(f"select {select} from {source}" for select, source in parts)


FOLD_STATS = (
    PRE
    + BLOCKS.format(source="pre")
    + """, per_fold as (
  select f.fold,
         count(*) filter (where block < f.fold) as n_train,
         count(*) filter (where block = f.fold) as n_test,
         avg(log_stars) filter (where block < f.fold) as train_mean,
         max(ingested_at) filter (where block < f.fold) as train_last_seen,
         min(ingested_at) filter (where block = f.fold) as test_first_seen
  from blk, (select unnest([1, 2, 3]) as fold) f group by f.fold),
predicted as (
  select blk.*, fold, exp(train_mean) - 1 as predicted from blk join per_fold on block = fold)
"""
)

SQUARED = "pow(ln(1 + case when predicted < 0 then 0 else predicted end) - ln(1 + stargazers_count), 2)"


def strength(clean: bool) -> str:
    names = strength_columns(clean)
    cells = ", ".join(f"coalesce(abs({corr(num(c), 'log_stars')}), 0e0) as {c}" for c in names)
    return (
        ENRICHED
        + BLOCKS.format(source="enriched")
        + f""", wide as (
  select f.fold, {cells} from blk join (select unnest([1, 2, 3]) as fold) f on block < f.fold group by f.fold),
per_fold as (unpivot wide on {', '.join(names)} into name feature value importance),
mean_imp as (select feature, avg(importance) as importance from per_fold group by feature)
"""
    )


def families(clean: bool) -> str:
    if clean:
        last = ("Velocity (Clean)", "contains(feature, 'per_day') and not contains(feature, 'star')")
    else:
        last = (
            "Velocity",
            "contains(feature, 'per_day') or contains(feature, 'ratio') "
            "or (starts_with(feature, 'log_') and not contains(feature, 'emb'))",
        )
    rules = [
        ("Metadata", "feature in ('" + "', '".join(schema.METADATA_FEATURES) + "')"),
        ("Embeddings", "starts_with(feature, 'readme_emb_')"),
        ("Owner", "starts_with(feature, 'owner_')"),
        ("Topic", "starts_with(feature, 'topic_')"),
        last,
    ]
    parts = " union all ".join(
        f"select '{name}' as family, coalesce(sum(importance) filter (where {rule}), 0e0) as importance, "
        f"count(*) filter (where {rule}) as n_features from top"
        for name, rule in rules
    )
    return (
        strength(clean)
        + f""", top as (select * from mean_imp),
fam as ({parts})
select family, {r6('importance')} as importance, round(100e0 * importance / sum(importance) over (), 1) as pct, n_features
from fam"""
    )


def matrix_sql() -> str:
    names = ["id", "stargazers_count", "watchers_count", "forks_count", "open_issues_count", "size"]
    pairs = [(b, a) for i, a in enumerate(names) for b in names[i + 1 :]]
    return REPOS + " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, {r6(corr(num(a), num(b)))} as correlation from repos"
        for a, b in pairs
    )


NUMERIC = ["id", "watchers_count", "forks_count", "open_issues_count", "size"]
RISK = """case when abs_correlation > 0.9 then 'CRITICAL' when abs_correlation > 0.7 then 'HIGH'
 when abs_correlation > 0.5 then 'MODERATE' else 'LOW' end"""
CORRS = (
    REPOS
    + ", c as ("
    + " union all ".join(
        f"select '{c}' as feature, {corr(num(c), num('stargazers_count'))} as correlation from repos" for c in NUMERIC
    )
    + "), ranked as (select feature, correlation, abs(correlation) as abs_correlation from c)"
)

DATED = REPOS + ", dated as (select *, ingested_at + to_days(cast(open_issues_count as integer) * 30) as updated_at from repos)"
DATED_COLUMNS = [
    "id",
    "name",
    "full_name",
    "owner_login",
    "language",
    "stargazers_count",
    "watchers_count",
    "forks_count",
    "open_issues_count",
    "size",
    "created_at",
    "ingested_at",
    "updated_at",
]


def safe_sql() -> str:
    rows = []
    for c in DATED_COLUMNS:
        if c in schema.NOT_FEATURES:
            continue
        bad = any(p in c for p in schema.LEAK_NAME_PARTS)
        number = c in NUMERIC
        rows.append(
            f"select '{c}' as feature, '{'excluded' if bad else 'safe'}' as verdict, "
            f"round(100e0 * count(*) filter (where {c} is null) / count(*), 2) as null_pct, "
            + (f"{r6('abs(' + corr(num(c), num('stargazers_count')) + ')')}" if number else "cast(null as double)")
            + " as abs_correlation, "
            + (f"round(100e0 * count(*) filter (where {c} = stargazers_count) / count(*), 2)" if number else "cast(null as double)")
            + " as match_pct from dated"
        )
    return DATED + " union all ".join(rows)


def guard_sql() -> str:
    names = ["watchers_count"] + [c for c in schema.feature_names(clean=False, embedding_dim=0) if c != "language"]
    rows = " union all ".join(
        f"select '{c}' as feature, abs({corr(num(c), num('stargazers_count'))}) as a from enriched" for c in names
    )
    leaking = "', '".join(schema.LEAKING_FEATURES)
    return (
        ENRICHED
        + f""", g as ({rows}),
v as (select feature, a, case when feature in ('{leaking}') then 1 else 0 end as named,
      case when a > 0.9 then 1 else 0 end as critical from g)
select feature, {r6('a')} as abs_correlation, named, critical, 1 - greatest(named, critical) as kept from v"""
    )


def report_sql(lines: bool = False) -> str:
    names = DATED_COLUMNS
    safe = ", ".join(c for c in names if c not in schema.NOT_FEATURES and not any(p in c for p in schema.LEAK_NAME_PARTS))
    excluded = ", ".join(c for c in names if c not in schema.NOT_FEATURES and any(p in c for p in schema.LEAK_NAME_PARTS))
    nulls = " + ".join(f"(case when count(*) > count({c}) then 1 else 0 end)" for c in names)
    strong = (
        "(select coalesce(string_agg(feature, ', ' order by abs_correlation desc, feature), '') "
        "from ranked where abs_correlation > {})"
    )
    entries = [
        ("data_quality", "total_rows", "(select cast(count(*) as varchar) from dated)"),
        ("data_quality", "total_cols", f"'{len(names)}'"),
        ("data_quality", "categorical_cols", "'4'"),
        ("data_quality", "null_columns", f"(select cast({nulls} as varchar) from dated)"),
        ("feature_leakage", "critical_features", strong.format("0.9")),
        ("feature_leakage", "high_risk_features", strong.format("0.7")),
        (
            "feature_leakage",
            "watchers_leakage",
            f"(select case when {corr(num('watchers_count'), num('stargazers_count'))} > 0.99 then 'True' else 'False' end from dated)",
        ),
        ("temporal_integrity", "date_columns", "'created_at, updated_at, ingested_at'"),
        ("temporal_integrity", "ingestion_max", "(select strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') from dated)"),
        ("safe_features", "safe_features", f"'{safe}'"),
        ("safe_features", "excluded_features", f"'{excluded}'"),
    ]
    dated = CORRS + ", dated as (select *, ingested_at + to_days(cast(open_issues_count as integer) * 30) as updated_at from repos) "
    if lines:
        return dated + " union all ".join(f"select '[{s}] {k}: ' || {v} as line" for s, k, v in entries)
    return dated + " union all ".join(
        f"select '{s}' as section, '{k}' as key, {v} as value" for s, k, v in entries
    )


def histogram_sql(source: str, column: str, view: bool) -> str:
    seen = (
        f", case when low <= (select quantile_cont({column}, 0.99) from {source}) then 1 else 0 end as in_view" if view else ""
    )
    return f""", sp as (select min({num(column)}) a, max({num(column)}) b from {source}),
s as (select case when a = b then a - 0.5e0 else a end lo, case when a = b then b + 0.5e0 else b end hi from sp),
f as (select cast(least(99, floor(({num(column)} - lo) / (hi - lo) * 100)) as integer) as bin, count(*) as n
      from {source}, s group by 1),
g as (select cast(range as integer) as bin from range(100)),
h as (select g.bin, lo + g.bin * ((hi - lo) / 100) as low, lo + (g.bin + 1) * ((hi - lo) / 100) as high, coalesce(n, 0) as n
      from g cross join s left join f on f.bin = g.bin)
select bin, {r6('low')} as low, {r6('high')} as high, n{seen} from h"""


SCENARIO_PARTS = f"""
select id, {r6('owner_mean_stars')} as owner_mean_stars, {r6('owner_total_stars')} as owner_total_stars,
 {r6('owner_repo_count')} as owner_repo_count, {r6('owner_mean_stars * 0.5e0')} as owner_std_stars,
 {r6('forks_count * 1.2e0')} as owner_mean_forks, {r6('forks_count * owner_repo_count')} as owner_total_forks,
 {num('age_days * 2')} as owner_tenure_days, {num('age_days * 2')} as owner_active_days,
 case when owner_mean_stars > 50 then 0.2e0 else 0.05e0 end as owner_success_rate, {num('owner_is_org')} as owner_is_org,
 {r6('ln(1 + owner_total_stars)')} as log_owner_total_stars, {r6('ln(1 + owner_repo_count)')} as log_owner_repo_count
from own"""


def known_or_default(columns: dict[str, float]) -> str:
    return ", ".join(f"case when k.owner_login is not null then {num('k.' + c)} else {v}e0 end as {c}" for c, v in columns.items())


# Figures of the time before the cutoff, for all rows.
FALLBACK = (
    REPOS.replace("repos as (", "everything as (")
    + f""", repos as (select * from everything where created_at < timestamp '{CUTOFF}'),
later as (select * from everything), """
    + OWNERS
    + f""", k as (select * from owners),
fb as (select r.*, {known_or_default(schema.OWNER_DEFAULTS)} from later r left join k on k.owner_login = r.owner_login),
prof as (select *, ln(1 + owner_total_stars) as log_owner_total_stars, ln(1 + owner_repo_count) as log_owner_repo_count from fb)
"""
)


def scoring_sql() -> str:
    names = schema.feature_names(clean=True)
    zero = set(schema.embedding_columns())
    codes = " ".join(f"when '{k}' then {schema.LANGUAGE_CODES[v]}" for k, v in LANGUAGE_OF.items())
    text = "lower(name || ' ' || full_name)"
    return (
        FALLBACK
        + f""", aged as (select *, {days('(select max(ingested_at) from everything)', 'created_at')} as age_days from prof),
t as (select * exclude (language), case language {codes} else 99 end as language, {topic_columns(text, schema.TOPIC_SUBSTRINGS, False)} from aged),
v as (select *, {topic_sum(schema.TOPIC_SUBSTRINGS)},
  forks_count / {SAFE_AGE} as forks_per_day, open_issues_count / {SAFE_AGE} as issues_per_day,
  ln(1 + forks_count / {SAFE_AGE}) as log_forks_per_day,
  ln(1 + open_issues_count / {SAFE_AGE}) as log_issues_per_day from t)
select id, {', '.join(f'cast({"0" if n in zero else f"coalesce({n}, -1)"} as float) as {n}' for n in names)} from v"""
    )


W0 = "least(40, greatest(5, ln(1 + owner_total_stars) * 4))"
W1 = f"least(25, greatest(2, forks_count / {SAFE_AGE} * 30))"
W2 = "least(20, greatest(2, length(full_name) / 20))"
W3 = "least(15, greatest(1, ln(1 + size)))"

def oracle_sql() -> dict[str, str]:
    blank = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    docs = "documents d left join labels using (doc_id)"
    sql = {
        "scan_parquet": "select * from orders",
        "sink_parquet_chunks": REPOS + "select * from repos",
        "json_flatten": REPOS
        + """, j as (select *, open_issues_count > 0 as has, stargazers_count s1, forks_count * 50 s2, forks_count f1, open_issues_count f2 from repos),
k as (select *, case when has then s1 + s2 else 100 end ts, case when has then 2 else 1 end n, case when has then f1 + f2 else 20 end tf from j)
select id, name, full_name, '' as description, size, coalesce(language, 'Unknown') as language, forks_count, open_issues_count,
 stargazers_count as actual_stars, created_at, owner_login, case when size > 250000 then 1 else 0 end as owner_is_org,
 forks_count as public_repos, """
        + f"""{num('ts')} as owner_total_stars, {r6('ts / n')} as owner_mean_stars,
 {r6('case when has then abs(s1 - s2) / 2 else 0 end')} as owner_std_stars, {num('tf')} as owner_total_forks,
 {r6('tf / n')} as owner_mean_forks,
 {r6('case when has then ((s1 > 100)::int + (s2 > 100)::int) / 2 else 0 end')} as owner_success_rate from k""",
        "json_props": """select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'none' as missing from events""",
        "csv_roundtrip": """with w as (select p_name as feature, sum(l_quantity) as importance from lineitem
 join part on p_partkey = l_partkey group by p_name),
t as (select * from w order by importance desc, feature limit 20)
select feature, importance, round(100e0 * importance / sum(importance) over (), 2) as pct from t""",
        "embedding_cache_incremental": """select doc_id, sha256(text) as text_hash,
 case when text in (select text from documents join labels using (doc_id)) then 1 else 0 end as from_cache, 384 as dim
from documents""",
        "embedding_store_incremental": """select doc_id, sha256(text) as text_hash,
 case when text in (select text from documents join labels using (doc_id)) then 1 else 0 end as from_cache, 384 as dim
from documents""",
        "union_parts": """select c_name as name, c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment from customer
 union all select s_name, s_nationkey, s_acctbal, null from supplier""",
        "parse_ts": "select event_id, ts as ts_utc, epoch_us(ts) - 7200000000 as shifted_us from events",
        "parse_ts_lenient": """select event_id, case when event_type <> 'error' then ts end as parsed,
 case when event_type = 'error' then 1 else 0 end as is_bad from events""",
        "age_days": f"""select event_id, {days('ts', "timestamp '2024-01-03 12:30:00'")} as days_after,
 {days("timestamp '2024-01-03 12:30:00'", 'ts')} as days_before from events""",
        "log_target": PRE + f"select id, {r6('log_stars')} as log_stars from pre",
        "preprocess": PRE + f"select id, language, age_days, {r6('log_stars')} as log_stars, created_at, ingested_at from pre",
        "age_filter": PRE + "select id, age_days from pre where age_days between 0 and 3650",
        "preprocess_violations": PRE
        + """select count(*) as n_rows, count(*) filter (where age_days is null) as null_age_days,
 count(*) filter (where log_stars is null) as null_log_stars from pre where age_days between 0 and 3650""",
        "temporal_split_counts": REPOS
        + f""", s as (
 select 'train' as side, count(*) as n_rows from repos where created_at < timestamp '{CUTOFF}'
 union all select 'test', count(*) from repos where created_at >= timestamp '{CUTOFF}')
select side, n_rows, case when side = 'test' and n_rows < 1000 then 1 else 0 end as small_test from s""",
        "feature_select": ENRICHED + f"select id, {listed(schema.feature_names(True, 0))} from enriched",
        "drop_sparse_columns": "select doc_id, lang, source, n_chars from documents",
        "fill_sentinel": f"select doc_id, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from {docs}",
        "median_impute": JOINED
        + f""", big as (select id, case when size > 100000 then size end as size from repos)
select r.id, {r6('coalesce(raw.owner_std_stars, (select median(owner_std_stars) from raw))')} as owner_std_stars,
 {r6('coalesce(raw.owner_mean_forks, (select median(owner_mean_forks) from raw))')} as owner_mean_forks,
 {r6('coalesce(big.size, (select median(size) from big))')} as size
from repos r join raw on raw.id = r.id join big on big.id = r.id""",
        "align_columns": PRE
        + """select id, cast(size as float) as size, cast(forks_count as float) as forks_count, cast(age_days as float) as age_days,
 cast(-1 as float) as topic_count, cast(open_issues_count as float) as open_issues_count from pre""",
        "apply_defaults": f"select doc_id, coalesce(quality, 0) as quality, coalesce(toxic, 1) as toxic, 'none' as license from {docs}",
        "owner_reputation": REPOS
        + ", "
        + OWNERS
        + f"""select owner_login, {r6('owner_mean_stars')} as owner_mean_stars, owner_total_stars, owner_repo_count,
 {r6('owner_std_stars')} as owner_std_stars, {r6('owner_mean_forks')} as owner_mean_forks, owner_total_forks,
 owner_first_repo, owner_last_repo, {r6('owner_success_rate')} as owner_success_rate, owner_tenure_days,
 owner_active_days, owner_is_org from owners""",
        "owner_features_joined": JOINED
        + f"select id, owner_login, {listed(schema.OWNER_MEASURES)}, owner_is_org, {listed([f'log_{c}' for c in schema.OWNER_LOGGED])} from own",
        "owner_is_org": f"""with g as (select concat_ws('-', n_name, c_mktsegment) as owner_login, count(*) as owner_repo_count
 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1)
select owner_login, owner_repo_count,
 case when regexp_matches(lower(owner_login), '{ORG}') or owner_repo_count > 100 then 1 else 0 end as owner_is_org from g""",
        "language_code_fixed": REPOS
        + "select id, language, case language "
        + " ".join(f"when '{k}' then {v}" for k, v in SEGMENT_CODES.items())
        + " else 99 end as language_code from repos",
        "owner_stats_fallback": FALLBACK
        + f"select id, {', '.join(f'{r6(c)} as {c}' for c in schema.OWNER_FEATURES)} from prof",
        "owner_stats_serving": REPOS
        + f""", li as (select owner_login, count(*) n, cast(sum(stargazers_count) as bigint) s, avg(stargazers_count) ms,
 stddev_pop(stargazers_count) sd, cast(sum(forks_count) as bigint) fk, avg(forks_count) mf,
 count(*) filter (where stargazers_count > 100) ok from repos group by owner_login),
fo as (select o_custkey, min(o_orderdate) fd from orders group by o_custkey),
p as (select c_name as owner_login, case when c_mktsegment = 'BUILDING' then 1 else 0 end as owner_is_org,
 case when c_mktsegment = 'FURNITURE' then 0 when c_mktsegment <> 'HOUSEHOLD' then c_nationkey end as pr,
 coalesce({days("timestamp '2001-12-31 00:00:00'", 'fd')}, 0) as tenure
 from customer left join fo on o_custkey = c_custkey
 union all select s_name, 0, s_nationkey, 0 from supplier),
z as (select p.*, li.* exclude (owner_login), coalesce(pr, n, 0) as c0 from p left join li on li.owner_login = p.owner_login),
y as (select owner_login, coalesce(ms, 100) as owner_mean_stars, coalesce(s, 100) as owner_total_stars,
 cast(case when c0 = 0 then 1 else c0 end as bigint) as owner_repo_count, coalesce(sd, 0) as owner_std_stars,
 coalesce(mf, 20) as owner_mean_forks, coalesce(fk, 20) as owner_total_forks, tenure as owner_tenure_days,
 tenure as owner_active_days, coalesce(ok, 0) / coalesce(n, 1) as owner_success_rate, owner_is_org from z)
select owner_login, {r6('owner_mean_stars')} as owner_mean_stars, owner_total_stars, owner_repo_count,
 {r6('owner_std_stars')} as owner_std_stars, {r6('owner_mean_forks')} as owner_mean_forks, owner_total_forks,
 owner_tenure_days, owner_active_days, {r6('owner_success_rate')} as owner_success_rate, owner_is_org,
 {r6('ln(1 + owner_total_stars)')} as log_owner_total_stars, {r6('ln(1 + owner_repo_count)')} as log_owner_repo_count from y""",
        "velocity": PRE
        + f", v as (select *, {VELOCITY} from pre) select id, age_days_safe, {listed(schema.VELOCITY_FEATURES)} from v",
        "velocity_missing_age": PRE
        + f""", w as (select * replace (case when open_issues_count > 0 then age_days end as age_days) from pre),
v as (select *, {VELOCITY} from w) select id, age_days_safe, {listed(schema.VELOCITY_FEATURES)} from v""",
        "velocity_clean": PRE
        + f""", v as (select *, {VELOCITY} from pre)
select id, {listed(['forks_per_day', 'issues_per_day', 'log_forks_per_day', 'log_issues_per_day'])} from v""",
        "topic_flags_regex": f"""with t as (select doc_id, {topic_columns("lower(source || ' ' || text)", schema.TOPIC_PATTERNS, True)} from documents)
select *, {topic_sum(schema.TOPIC_PATTERNS)} from t""",
        "topic_flags_custom": f"""with t as (select p_partkey, {topic_columns("lower(p_name)", PART_TOPICS, True)} from part)
select *, {topic_sum(PART_TOPICS)} from t""",
        "topic_flags_substring": f"""with t as (select doc_id, {topic_columns("lower(source || ' ' || text)", schema.TOPIC_SUBSTRINGS, False)} from documents)
select *, {topic_sum(schema.TOPIC_SUBSTRINGS)} from t""",
        "embedding_text": f"""with b as (select doc_id, trim(text, {blank}) as body, trim(source, {blank}) as name from documents),
c as (select doc_id, case when length(body) > 0 then body else coalesce(name, '{schema.NO_TEXT}') end as chosen from b)
select doc_id, chosen as embedding_text,
 cast(case when length(chosen) > 2000 then 2003 else length(chosen) end as integer) as limited_length from c""",
        "embedding_wide": "select vec_id, " + ", ".join(f"embedding[{i + 1}] as emb_{i}" for i in range(64)) + " from embeddings",
        "embedding_validation": f"""select count(*) as n_rows, cast(min(len(embedding)) as integer) as min_dim, cast(max(len(embedding)) as integer) as max_dim,
 cast(coalesce(sum(len(list_filter(embedding, lambda x: x is null))), 0) as bigint) as null_elements,
 count(*) filter (where embedding is null) as null_vectors,
 {r6('avg(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))))')} as mean_norm
from embeddings""",
        "text_embed_shape": f"""select doc_id, 384 as dim, case when length(trim(text, {blank})) > 0 then 1e0 else 0e0 end as norm from documents""",
        "scan_first_n_files": """with q as (select *, 4 * o_orderkey // ((select max(o_orderkey) from orders) + 1) as quarter from orders)
select o_orderstatus, count(*) as n, max(o_orderkey) as last_key from q where quarter < 2 group by 1""",
        "scoring_vector_floored": REPOS
        + f""", f as (select min(created_at) as t from repos where created_at < timestamp '{CUTOFF}')
select id, cast(case when forks_count > 1 then case when {days('f.t', 'created_at')} < 1 then 1 else {days('f.t', 'created_at')} end
 else 305 end as float) as age_days, cast(size as float) as size from repos, f where created_at >= timestamp '{CUTOFF}'""",
        "owner_reputation_as_of": PRE
        + f""", h as (select *, count(stargazers_count) over w as n, coalesce(sum(stargazers_count) over w, 0) as s,
 avg(stargazers_count) over w as m, stddev_samp(stargazers_count) over w as sd, avg(forks_count) over w as f,
 avg(case when stargazers_count > 100 then 1e0 else 0e0 end) over w as ok, min(created_at) over w as first_at
 from pre window w as (partition by owner_login order by created_at, id rows between unbounded preceding and 1 preceding))
select id, owner_login, n as owner_prior_count, {num('s')} as owner_prior_total_stars, {r6('m')} as owner_prior_mean_stars,
 {r6('sd')} as owner_prior_std_stars, {r6('f')} as owner_prior_mean_forks, {r6('ok')} as owner_prior_success_rate,
 {days('created_at', 'first_at')} as owner_prior_days from h""",
        "owner_reputation_loo": PRE
        + f""", t as (select owner_login, count(*) as n, sum(stargazers_count) as s, sum(forks_count) as f,
 count(*) filter (where stargazers_count > 100) as ok from pre group by owner_login),
j as (select id, p.owner_login, n - 1 as n, s - stargazers_count as s, f - forks_count as f,
 ok - (stargazers_count > 100)::int as ok from pre p join t on t.owner_login = p.owner_login)
select id, owner_login, n as owner_loo_count, {num('s')} as owner_loo_total_stars,
 case when n > 0 then {r6('s / n')} end as owner_loo_mean_stars, case when n > 0 then {r6('f / n')} end as owner_loo_mean_forks,
 case when n > 0 then {r6('ok / n')} end as owner_loo_success_rate from j""",
        "correlation_matrix_wide": f"""with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as k from embeddings)
select 'emb_' || a.k as feature_a, 'emb_' || b.k as feature_b, {r6('corr(a.x, b.x)')} as correlation
from v a join v b on a.vec_id = b.vec_id and a.k > b.k group by a.k, b.k""",
        "quantile_sketch": REPOS
        + """select c as "column", p as prob, (select count(*) from repos) as n, 1 as rank_ok
from (select unnest(['stargazers_count', 'size', 'forks_count']) as c), (select unnest([0.01e0, 0.25e0, 0.5e0, 0.75e0, 0.99e0]) as p)""",
        "scan_mixed_types": """select cast(l_orderkey as varchar) as l_orderkey, l_linenumber,
 case when l_linenumber <= 3 then trunc(l_quantity) else l_quantity end as l_quantity,
 case when l_linenumber <= 3 then l_returnflag end as l_returnflag, case when l_linenumber <= 3 then 0 else 1 end as part from lineitem""",
        "sink_chunk_sizes": f"""with f as (select (row_number() over () - 1) // {schema.ROWS_PER_FILE} as file from lineitem),
s as (select count(*) as n_rows from f group by file) select n_rows, count(*) as n_files from s group by n_rows""",
        "json_rescue": "with d as (select o_orderkey as k from orders) "
        + " union all ".join(
            f"select '{field}' as field, count(*) filter (where {bad}) as n_bad, count(*) as n_documents from d"
            for field, bad in [
                ("*", "k % 7 = 0"),
                *[
                    (f, {"size": "k % 7 <> 0 and k % 5 = 0", "forks_count": "k % 7 <> 0 and k % 3 = 0"}.get(f, "false"))
                    for f in schema.REPO_DOCUMENT.names
                ],
            ]
        ),
        "model_roundtrip": REPOS + "select id, 5 as input_features, 0e0 as difference from repos",
        "array_stats": f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
select vec_id, {r6('list_sum(v)')} as total, {r6('list_avg(v)')} as mean, {r6('list_stddev_pop(v)')} as std,
 cast(len(list_filter(v, lambda x: x > 0.1e0)) as integer) as n_above from e""",
        "math_features": REPOS
        + f"""select id, {r6('ln(1 + size)')} as log1p_size, {r6('forks_count')} as expm1_forks,
 abs(open_issues_count - forks_count) as abs_gap, {r6('sqrt(size)')} as sqrt_size, least(greatest(size, 1000), 300000) as clipped_size,
 round(size / 1024, 2) as size_mb, (size + 19999) // 20000 as chunks, {r6('open_issues_count / forks_count')} as issue_rate from repos""",
        "string_features": """select page_id, lower(url) as lowered, case when regexp_matches(lower(url), 'blog|spam') then 1 else 0 end as has_word,
 case when starts_with(url, 'https://') then 1 else 0 end as is_https, case when contains(url, 'example') then 1 else 0 end as has_example,
 rtrim(url, '/') as no_slash, replace(url, 'https://', '') as no_scheme, split_part(url, '/', 3) as host,
 substring(url, 1, 12) || '...' as short, cast(length(html) as integer) as html_length,
 concat_ws(' ', url, split_part(url, '/', 4)) as joined, split_part(url, '/', 3) || ': ' || length(url) as label from pages""",
        "risk_bands": REPOS
        + f""", q as (select id, open_issues_count / forks_count as rate from repos)
select id, {r6('rate')} as rate, case when rate > 0.9 then 'CRITICAL' when rate > 0.7 then 'HIGH'
 when rate > 0.5 then 'MODERATE' else 'LOW' end as risk from q""",
        "label_encode": PRE
        + """, n as (select name, row_number() over (order by name) - 1 as name_code from (select distinct name from pre)),
g as (select language, row_number() over (order by language) - 1 as language_code from (select distinct language from pre))
select id, name, name_code, language, language_code from pre join n using (name) join g using (language)""",
        "label_encode_holdout": PRE
        + f""", n as (select full_name, row_number() over (order by full_name) - 1 as code
 from (select distinct full_name from pre where created_at < timestamp '{CUTOFF}'))
select id, pre.full_name, coalesce(code, -1) as name_code from pre left join n on n.full_name = pre.full_name""",
        "table_shape": REPOS
        + """select count(*) as n_rows, 12 as n_cols, 'id, name, full_name, owner_login, language, stargazers_count, watchers_count, forks_count, open_issues_count, size, created_at, ingested_at' as columns from repos""",
        "null_profile": REPOS
        + ", "
        + OWNERS
        + """, j as (select r.*, o.owner_std_stars from repos r left join owners o on o.owner_login = r.owner_login),
n as (select 'language' as "column", count(*) - count(language) as null_count, count(*) as t from j
 union all select 'owner_std_stars', count(*) - count(owner_std_stars), count(*) from j)
select "column", null_count, round(100e0 * null_count / t, 2) as null_pct from n where null_count > 0""",
        "null_profile_nan": REPOS
        + """, n as (select 'language' as "column", count(*) - count(language) as null_count, count(*) as t from repos
 union all select 'rate', count(*) filter (where open_issues_count = 0), count(*) from repos
 union all select 'rate_null', count(*) filter (where open_issues_count = 0), count(*) from repos)
select "column", null_count, round(100e0 * null_count / t, 2) as null_pct from n where null_count > 0""",
        "category_profile": REPOS
        + ", v as ("
        + " union all ".join(
            f"""select '{c}' as "column", {c} as value from repos where {c} is not null"""
            for c in ("name", "full_name", "owner_login", "language")
        )
        + """), c as (select "column", value, count(*) as n from v group by all),
r as (select *, count(*) over (partition by "column") as n_unique,
 row_number() over (partition by "column" order by n desc, value) as rank from c)
select "column", n_unique, rank, value, n, round(100e0 * n / (select count(*) from repos), 2) as pct from r where rank <= 5""",
        "category_top": REPOS
        + ", v as ("
        + " union all ".join(
            f"""select '{c}' as "column", {c} as value from repos where {c} is not null"""
            for c in ("name", "full_name", "owner_login", "language")
        )
        + """), c as (select "column", value, count(*) as n from v group by all),
r as (select *, row_number() over (partition by "column" order by n desc, value) as rank from c)
select "column", rank, value, n, round(100e0 * n / (select count(*) from repos), 2) as pct from r where rank <= 5""",
        "date_ranges": DATED
        + " union all ".join(
            f"""select '{c}' as "column", min({c}) as min_date, max({c}) as max_date from dated"""
            for c in ("created_at", "updated_at", "ingested_at")
        ),
        "target_summary": REPOS
        + f"""select count(stargazers_count) as n, {r6('avg(stargazers_count)')} as mean, {num('min(stargazers_count)')} as min,
 {num('max(stargazers_count)')} as max, {num('median(stargazers_count)')} as median,
 {r6('quantile_cont(stargazers_count, 0.99)')} as q99 from repos""",
        "leakage_correlations": CORRS
        + f"select feature, {r6('correlation')} as correlation, {r6('abs_correlation')} as abs_correlation, {RISK} as risk from ranked",
        "mirror_check": REPOS
        + f"""select {r6(corr(num('watchers_count'), num('stargazers_count')))} as correlation,
 100e0 * count(*) filter (where watchers_count = stargazers_count) / count(*) as exact_match_pct,
 {num('max(abs(watchers_count - stargazers_count))')} as max_difference, avg(abs(watchers_count - stargazers_count)) as mean_difference,
 case when {corr(num('watchers_count'), num('stargazers_count'))} > 0.99
  or 100e0 * count(*) filter (where watchers_count = stargazers_count) / count(*) > 95 then 1 else 0 end as leaks from repos""",
        "risk_lists": CORRS
        + """, b as (select 'CRITICAL' as band, 0.9 as t union all select 'HIGH', 0.7)
select band, string_agg(feature, ', ' order by abs_correlation desc, feature) as features, count(*) as n
from ranked join b on abs_correlation > t group by band""",
        "future_dates": DATED
        + " union all ".join(
            f"""select '{c}' as "column", count(*) filter (where {c} > (select max(ingested_at) from dated)) as n_future,
 round(100e0 * count(*) filter (where {c} > (select max(ingested_at) from dated)) / count(*), 2) as future_pct from dated"""
            for c in ("created_at", "updated_at")
        ),
        "safe_features": safe_sql(),
        "correlation_matrix": matrix_sql(),
        "target_correlation": PRE
        + " union all ".join(
            f"select '{c}' as feature, {r6(corr(num(c), 'log_stars'))} as correlation from pre where age_days between 0 and 3650"
            for c in ("age_days", "forks_count", "watchers_count", "open_issues_count", "size", "log_stars")
        ),
        "leak_guard": guard_sql(),
        "target_histogram": REPOS + histogram_sql("repos", "stargazers_count", True),
        "log_target_histogram": PRE + histogram_sql("pre", "log_stars", False),
        "target_kde": REPOS
        + f""", c as (select {num('stargazers_count')} as x, count(*) as w from repos group by 1),
s as (select min({num('stargazers_count')}) lo, max({num('stargazers_count')}) hi, count(*) n,
 stddev_samp(stargazers_count) * pow(count(*), -0.2e0) h from repos),
g as (select cast(range as integer) as point, lo + range * ((hi - lo) / 199) as grid_x from range(200), s)
select point, {r6('any_value(grid_x)')} as grid_x,
 {r6('sum(w * exp(-0.5e0 * ((grid_x - x) / h) * ((grid_x - x) / h))) / any_value(n * h * sqrt(2 * pi()))')} as density
from g, c, s group by point""",
        "target_kde_binned": REPOS
        + f""", c as (select {num('stargazers_count')} as x, count(*) as w from repos group by 1),
s as (select min({num('stargazers_count')}) lo, max({num('stargazers_count')}) hi, count(*) n,
 stddev_samp(stargazers_count) * pow(count(*), -0.2e0) h from repos),
g as (select cast(range as integer) as point, lo + range * ((hi - lo) / 199) as grid_x from range(200), s)
select point, {r6('any_value(grid_x)')} as grid_x,
 {r6('sum(w * exp(-0.5e0 * ((grid_x - x) / h) * ((grid_x - x) / h))) / any_value(n * h * sqrt(2 * pi()))')} as density
from g, c, s group by point""",
        "scatter_sample": REPOS
        + """, k as (select id, watchers_count, stargazers_count from repos order by md5(concat(id, ':', 42)), id limit 10000)
select *, (select greatest(max(watchers_count), max(stargazers_count)) from k) as line_end from k""",
        "audit_report": report_sql(),
        "audit_report_text": report_sql(lines=True),
        "time_row_index": REPOS + "select id, row_number() over (order by ingested_at, id) - 1 as row_idx from repos",
        "topn_share": """with w as (select l_returnflag, l_partkey, sum(l_quantity) as weight from lineitem group by all),
r as (select *, row_number() over (partition by l_returnflag order by weight desc, l_partkey) as rank from w)
select l_returnflag, l_partkey, weight, rank, round(100e0 * weight / sum(weight) over (partition by l_returnflag), 2) as pct
from r where rank <= 20""",
        "sample_n": """select o_orderkey, o_totalprice from orders order by md5(concat(o_orderkey, ':', 42)), o_orderkey limit 10000""",
        "ts_fold_bounds": REPOS
        + """, n as (select count(*) as n_rows from repos), f as (select unnest([1, 2, 3]) as fold)
select fold, n_rows - (3 - fold + 1) * (n_rows // 4) as test_start, n_rows - (3 - fold + 1) * (n_rows // 4) + n_rows // 4 as test_end,
 n_rows // 4 as n_test from n, f""",
        "ts_fold_stats": FOLD_STATS
        + f"select fold, n_train, n_test, {r6('train_mean')} as train_mean, train_last_seen, test_first_seen from per_fold",
        "rmsle": REPOS
        + ", "
        + OWNERS
        + f""", p as (select r.*, o.owner_mean_stars as predicted from repos r left join owners o on o.owner_login = r.owner_login)
select count(predicted) as n, count(*) - count(predicted) as n_missing, {r6(f'sqrt(avg({SQUARED}))')} as rmsle from p""",
        "cv_summary": FOLD_STATS
        + f""", s as (select fold, sqrt(avg({SQUARED})) as rmsle from predicted group by fold)
select count(*) as folds, {r6('avg(rmsle)')} as mean_rmsle, {r6('stddev_pop(rmsle)')} as std_rmsle,
 string_agg(printf('%.4f', rmsle), ', ' order by fold) as scores from s""",
        "run_assessment": FOLD_STATS
        + f""", s as (select language, fold, count(predicted) as n, count(*) - count(predicted) as n_missing, sqrt(avg({SQUARED})) as rmsle from predicted group by language, fold),
g as (select *, (0.6921e0 - rmsle) / 0.6921e0 * 100 as gain, (rmsle - 0.6921e0) / 0.6921e0 * 100 as gap from s)
select language, fold, n, n_missing, {r6('rmsle')} as rmsle, {r6('gain')} as improvement_pct,
 case when gain < 5 then 'modest' when gain < 15 then 'good' else 'excellent' end as improvement_band,
 case when rmsle < 0.58e0 then 'excellent' when rmsle < 0.63e0 then 'on_target' else 'above_target' end as target_band_all,
 case when rmsle < 0.58e0 then 'excellent' when rmsle < 0.65e0 then 'on_target' else 'above_target' end as target_band_clean,
 {r6('gap')} as gap_pct, case when gap > 20 then 'large' when gap > 10 then 'moderate' else 'excellent' end as gap_band,
 case when gap > 20 then 0 else 1 end as is_valid, {r6('rmsle - 0.6921e0')} as vs_metadata, {r6('rmsle - 0.6639e0')} as vs_embeddings,
 {r6('rmsle - 0.1491e0')} as vs_leaked from g""",
        "importance_mean": strength(clean=False) + f"select feature, {r6('importance')} as importance from mean_imp",
        "family_share": families(clean=True),
        "family_share_all": families(clean=False),
        "url_parts": """with p as (select page_id, string_split(rtrim(replace(url, 'https://', ''), '/'), '/') as parts from pages)
select page_id, case when len(parts) >= 2 then parts[1] end as owner_login, case when len(parts) >= 2 then parts[2] end as repo_name,
 case when len(parts) >= 2 then 1 else 0 end as is_valid from p""",
        "what_if_owner": JOINED + SCENARIO_PARTS,
        "scoring_vector": scoring_sql(),
        "performance_class": JOINED
        + f"""select id, stargazers_count, {r6('owner_mean_stars')} as owner_mean_stars,
 case when stargazers_count / (owner_mean_stars + 1e-5) > 1.5 then 'overperforming'
 when stargazers_count / (owner_mean_stars + 1e-5) < 0.6 then 'underperforming' else 'aligned' end as performance from own""",
        "popularity_band": JOINED
        + """select id, owner_total_stars as predicted, case when owner_total_stars < 100 then '0-100' when owner_total_stars < 1000 then '100-1000'
 when owner_total_stars < 5000 then '1000-5000' else '5000+' end as band, greatest(5000e0, owner_total_stars * 1.5e0) as axis_end from own""",
        "contribution_breakdown": JOINED
        + f""", w as (select id, {W0} as w0, {W1} as w1, {W2} as w2, {W3} as w3 from own),
s as (select *, w0 + w1 + w2 + w3 as t from w)
"""
        + " union all ".join(
            f"select id, '{c}' as category, {r6(f'w{i} / t * 100')} as influence_pct from s"
            for i, c in enumerate(["Owner Reputation", "Velocity & Activity", "README Embeddings", "Base Metadata"])
        ),
        "repo_summary": JOINED
        + f"""select id, language as primary_language, {r6('size / 1024')} as size_mb, {SAFE_AGE} as age_days,
 {num('owner_total_stars')} as owner_total_stars from own""",
        "sample_fraction": """with k as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line, l_quantity from lineitem),
r as (select *, row_number() over (order by md5(concat(line, ':', 42)), line) as rn from k)
select line, l_quantity from r where rn <= (select round_even(count(*) * 0.2e0, 0) from k)""",
    }
    return sql
