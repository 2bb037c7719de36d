"""The queries over whole tables, and their SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repo_signals.llm.chat import fit_roles, format_transcripts, symbol, transcripts
from repo_signals.llm.conversation_repair import damaged, repair_report
from repo_signals.llm.exact_dedup import exact_dedup
from repo_signals.llm.importance import importance_resample
from repo_signals.llm.langid import identify_language, train_langid
from repo_signals.llm.line_templates import line_report
from repo_signals.llm.ngram_join import similar_documents
from repo_signals.llm.packing import binary_pieces
from repo_signals.llm.pieces import encode_pieces
from repo_signals.llm.quality_model import fit_quality_model, quality_scores
from repo_signals.llm.quality_rules import fit_quality_rules, quality_rules
from repo_signals.llm.secret_scan import scan_secrets
from repo_signals.llm.simhash import simhash_groups


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(folds: int) -> Column:
    """The fold of a document, from its identifier written as text."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations; the model is fitted on four folds of five, by ``conv_id``."""
    lines = transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    seen = lines.withColumn("symbol", symbol(F.col("line"), F.col("pos") == 0))
    return format_transcripts(lines, fit_roles(seen.where(F.crc32(F.col("conv_id").cast("string")) % 5 != 0)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_langid(docs, fold(4) != 2)
    return identify_language(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, fit_quality_rules(docs, labels(spark, sf_dir)))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality_model(docs, labels(spark, sf_dir), fold(5) != 0)
    return quality_scores(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_pieces(documents(spark, sf_dir))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(conversations), conversations)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_exact_dedup": op5_exact_dedup,
    "op1_ngram_join": op1_ngram_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_langid": op4_langid,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_templates": op7_line_templates,
    "op8_quality_model": op8_quality_model,
    "op9_pieces": op9_pieces,
    "op10_packing": op10_packing,
    "op11_repair": op11_repair,
    "op12_simhash": op12_simhash,
    "op13_importance": op13_importance,
}

# SQL translate() changes A-Z alone, as the operators do.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# One entry per byte value, and the CRC-32 of a string by it.
CRC_TABLE = """
    select list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t
"""


def crc_of(hexadecimal: str) -> str:
    """SQL for the CRC-32 of bytes written as hexadecimal digits, with the table ``crc`` at hand."""
    return f"""xor(list_reduce(
        list_transform(range(len({hexadecimal}) // 2), lambda k: ('0x' || substr({hexadecimal}, 2 * k + 1, 2))::bigint),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"""


def dearer(cell: str, cost: object, edit: str) -> str:
    """SQL for a repair so far, eight digits of cost before its audit, with one more edit; an empty one stays impossible."""
    return f"case when {cell} = '~' then '~' else lpad((substr({cell}, 1, 8)::int + {cost})::varchar, 8, '0') || substr({cell}, 9) || '{edit}' end"


def repair_step(row: str) -> str:
    """SQL for the best repairs up to each of the four places, after one more row.

    ``x`` holds them at its even positions behind the first.
    """
    deleted = [dearer(f"x[{p}]", 2, "D") for p in (1, 2, 3, 4)]

    def kept(p: int, label: str) -> list[str]:
        own = f"case when {row}.mark = '-' then '~' else {{}} end"
        extra = f"case when {row}.mark = '!' then 5 else 0 end"
        same = f"case when {row}.initial = '{label}' then {dearer(f'x[{p}]', extra, 'K')} else '~' end"
        return [own.format(same)] + ([own.format(dearer(f"x[{p}]", f"1 + {extra}", "R"))] if label != "s" else [])

    asked = [deleted[2], *kept(1, "u"), *kept(2, "u"), *kept(4, "u")]
    answered = [deleted[3], *kept(3, "a")]
    return f"[{deleted[0]}, least({deleted[1]}, {', '.join(kept(1, 's'))}), least({', '.join(asked)}), least({', '.join(answered)})]"


def repair_inserts(cells: str) -> str:
    """SQL for the same after rows put in: a question first, then an answer to it, or a question behind an answer."""
    asked = f"list_transform([{cells}], lambda x: [x[1], x[2], least(x[3], {', '.join(dearer(f'x[{p}]', 5, 'I') for p in (1, 2, 4))}), x[4]])[1]"
    return f"list_transform([{asked}], lambda x: [x[1], x[2], x[3], least(x[4], {dearer('x[3]', 5, 'I')})])[1]"


ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
        with recursive worded as (
            select doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents
        ),
        grams as (
            select distinct doc_id, unnest(
                case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4])
                    when len(w) > 0 then [w] else [] end
            ) as gram
            from worded
        ),
        sizes as (select doc_id, count(*) as n from grams group by doc_id),
        shared as (
            select a.doc_id as x, b.doc_id as y, count(*) as n
            from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all
        ),
        links as (
            select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
            where 100 * shared.n >= 80 * (p.n + q.n - shared.n)
        ),
        edges as (select x, y from links union select y, x from links),
        reach(doc_id, root) as (
            select doc_id, doc_id from documents
            union select y, root from reach join edges on x = doc_id
        )
        select doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id
        from reach left join sizes using (doc_id) group by doc_id
    """,
    "op5_exact_dedup": f"""
        with d as (select doc_id, {FOLDED} as body from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
            row_number() over (partition by body order by doc_id desc nulls last) = 1 as kept, sha256(body) as text_sha256
        from d window g as (partition by body)
    """,
    "op7_line_templates": r"""
        with texts as (select distinct text from documents where text is not null),
        split as (
            select text, unnest(string_split(text, chr(10))) as line,
                generate_subscripts(string_split(text, chr(10)), 1) as k
            from texts
        ),
        worded as (
            select text, line, k,
                list_transform(
                    regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
                    lambda w: case when regexp_matches(w, '[0-9]') then '< >' else w end
                ) as words
            from split
        ),
        entries as (
            select distinct text, len(words) as n, words[1:3] as lead, words,
                case when len(words) < 8 then 12 else greatest(2, 5 - (len(words) - 8) // 14) end as needed
            from worded where len(words) >= 3
        ),
        busy as (
            select * from entries semi join (
                select n, lead from entries group by n, lead having count(distinct text) >= any_value(needed)
            ) using (n, lead)
        ),
        places as (
            select n, lead, words, needed, text, unnest(words) as word, generate_subscripts(words, 1) as place from busy
        ),
        common as (
            select n, lead, place, word from places where word != '< >' group by all
            having count(distinct text) >= least(5, any_value(needed))
        ),
        shaped as (
            select n, lead, words, text, needed, list((place, word) order by place) as template
            from places join common using (n, lead, place, word) group by n, lead, words, text, needed
        ),
        fixed as (select * from shaped where 100 * len(template) >= 50 * n),
        often as (
            select n, lead, template, min(md5(text)) as keeper from fixed
            group by all having count(distinct text) >= any_value(needed)
        ),
        recurring as (select distinct words, keeper from fixed join often using (n, lead, template)),
        marked as (
            select w.text, line, k, coalesce(md5(w.text) > keeper, false) as gone from worded w left join recurring using (words)
        ),
        cleaned as (
            select text, coalesce(string_agg(line, chr(10) order by k) filter (not gone), '') as kept,
                count(*) as n_lines, count(*) filter (gone) as n_dropped
            from marked group by text
        )
        select doc_id, n_lines, n_dropped, kept as text from documents join cleaned using (text)
        union all
        select doc_id, 0, 0, null from documents where text is null
    """,
    "op11_repair": op11_repair,
    "op12_simhash": op12_simhash,
    "op13_importance": op13_importance,
}

# SQL translate() changes A-Z alone, as the operators do.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# One entry per byte value, and the CRC-32 of a string by it.
CRC_TABLE = """
    select list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t
"""


def crc_of(hexadecimal: str) -> str:
    """SQL for the CRC-32 of bytes written as hexadecimal digits, with the table ``crc`` at hand."""
    return f"""xor(list_reduce(
        list_transform(range(len({hexadecimal}) // 2), lambda k: ('0x' || substr({hexadecimal}, 2 * k + 1, 2))::bigint),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"""


def dearer(cell: str, cost: object, edit: str) -> str:
    """SQL for a repair so far, eight digits of cost before its audit, with one more edit; an empty one stays impossible."""
    return f"case when {cell} = '~' then '~' else lpad((substr({cell}, 1, 8)::int + {cost})::varchar, 8, '0') || substr({cell}, 9) || '{edit}' end"


def repair_step(row: str) -> str:
    """SQL for the best repairs up to each of the four places, after one more row.

    ``x`` holds them at its even positions behind the first.
    """
    deleted = [dearer(f"x[{p}]", 2, "D") for p in (1, 2, 3, 4)]

    def kept(p: int, label: str) -> list[str]:
        own = f"case when {row}.mark = '-' then '~' else {{}} end"
        extra = f"case when {row}.mark = '!' then 5 else 0 end"
        same = f"case when {row}.initial = '{label}' then {dearer(f'x[{p}]', extra, 'K')} else '~' end"
        return [own.format(same)] + ([own.format(dearer(f"x[{p}]", f"1 + {extra}", "R"))] if label != "s" else [])

    asked = [deleted[2], *kept(1, "u"), *kept(2, "u"), *kept(4, "u")]
    answered = [deleted[3], *kept(3, "a")]
    return f"[{deleted[0]}, least({deleted[1]}, {', '.join(kept(1, 's'))}), least({', '.join(asked)}), least({', '.join(answered)})]"


def repair_inserts(cells: str) -> str:
    """SQL for the same after rows put in: a question first, then an answer to it, or a question behind an answer."""
    asked = f"list_transform([{cells}], lambda x: [x[1], x[2], least(x[3], {', '.join(dearer(f'x[{p}]', 5, 'I') for p in (1, 2, 4))}), x[4]])[1]"
    return f"list_transform([{asked}], lambda x: [x[1], x[2], x[3], least(x[4], {dearer('x[3]', 5, 'I')})])[1]"


ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
        with recursive worded as (
            select doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents
        ),
        grams as (
            select distinct doc_id, unnest(
                case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: w[k:k + 4])
                    when len(w) > 0 then [w] else [] end
            ) as gram
            from worded
        ),
        sizes as (select doc_id, count(*) as n from grams group by doc_id),
        shared as (
            select a.doc_id as x, b.doc_id as y, count(*) as n
            from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all
        ),
        links as (
            select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
            where 100 * shared.n >= 80 * (p.n + q.n - shared.n)
        ),
        edges as (select x, y from links union select y, x from links),
        reach(doc_id, root) as (
            select doc_id, doc_id from documents
            union select y, root from reach join edges on x = doc_id
        )
        select doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id
        from reach left join sizes using (doc_id) group by doc_id
    """,
    "op5_exact_dedup": f"""
        with d as (select doc_id, {FOLDED} as body from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
            row_number() over (partition by body order by doc_id desc nulls last) = 1 as kept, sha256(body) as text_sha256
        from d window g as (partition by body)
    """,
    "op7_line_templates": r"""
        with texts as (select distinct text from documents where text is not null),
        split as (
            select text, unnest(string_split(text, chr(10))) as line,
                generate_subscripts(string_split(text, chr(10)), 1) as k
            from texts
        ),
        worded as (
            select text, line, k,
                list_transform(
                    regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
                    lambda w: case when regexp_matches(w, '[0-9]') then '< >' else w end
                ) as words
            from split
        ),
        entries as (
            select len(words) as n, words[1:3] as lead, words, count(distinct text) as docs
            from worded where len(words) >= 3 group by all
        ),
        places as (
            select n, lead, words, docs, unnest(words) as word, generate_subscripts(words, 1) as place from entries
        ),
        common as (
            select n, lead, place, word from places where word != '< >' group by all having sum(docs) >= 5
        ),
        shaped as (
            select n, lead, words, docs, list((place, word) order by place) as template
            from places join common using (n, lead, place, word) group by n, lead, words, docs
        ),
        fixed as (select * from shaped where 100 * len(template) >= 50 * n),
        often as (
            select n, lead, template from fixed group by all having sum(docs) >= case when n >= 8 then 5 else 12 end
        ),
        recurring as (select words from fixed join often using (n, lead, template)),
        marked as (
            select text, line, k, len(words) as n, words in (select words from recurring) as hit from worded
        ),
        judged as (
            select text, sum(n) filter (hit) as gone, sum(n) as n_words from marked group by text
        ),
        cleaned as (
            select text, string_agg(line, chr(10) order by k) as kept, count(*) as n_kept
            from marked join judged using (text)
            where not (hit and 100 * gone <= 50 * n_words) group by text
        )
        select doc_id, len(string_split(text, chr(10))) as n_lines,
            len(string_split(text, chr(10))) - n_kept as n_dropped, kept as text
        from documents join cleaned using (text)
        union all
        select doc_id, 0, 0, null from documents where text is null
    """,
    "op11_repair": rf"""
        with crc as ({CRC_TABLE}),
        given as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h
            from conversations
        ),
        cases as (select conv_id, turn, role, text, {crc_of("h")} % 20 as c from given, crc),
        damaged as (
            select conv_id, turn, case when c = 4 then 'user' else role end as role,
                case when c = 1 then '' when c = 2 then translate(text, '.!?', '') else text end as text,
                unnest(range(case when c = 3 then 2 else 1 end)) as copy
            from cases where c != 0
        ),
        ordered as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
                row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as time,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
            from damaged
        ),
        marked as (
            select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by k) as before,
                case when body = '' then 'blank' when time > 1 then 'duplicate'
                    when right(body, 1) not in ('.', '!', '?') then 'truncated' end as fault
            from ordered
        ),
        coded as (
            select *, case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then '!' else '' end as mark
            from marked
        ),
        per as (
            select conv_id,
                coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
                count(*) filter (fault = 'blank') as blank,
                count(*) filter (fault = 'duplicate') as duplicate,
                count(*) filter (fault = 'truncated') as truncated,
                count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
                list({{'initial': initial, 'mark': mark}} order by k) as codes,
                list({{'role': role, 'text': text}} order by k) as turns
            from coded group by conv_id
        ),
        parsed as (
            select *, list_reduce(
                list_transform(codes, lambda r: {{'row': r, 'x': ['~', '~', '~', '~']}}),
                lambda s, n: {{'row': n.row, 'x': STEP}},
                {{'row': codes[1], 'x': ['00000000', '~', '00000005I', '00000010II']}}
            ).x as x
            from per
        ),
        judged as (
            select *, substr(least(x[1], x[4]), 1, 8)::bigint as cost, substr(least(x[1], x[4]), 9) as audit from parsed
        ),
        edits as (
            select conv_id, turns, audit, unnest(string_split(audit, '')) as edit,
                unnest(range(1, len(audit) + 1)) as k
            from judged where audit != ''
        ),
        read as (
            select conv_id, k, edit,
                turns[count(*) filter (edit != 'I') over (partition by conv_id order by k)] as turn
            from edits
        ),
        kept as (
            select *, count(*) over (partition by conv_id order by k) as place,
                coalesce(first_value(case when edit = 'K' and left(turn.role, 1) = 's' then 1 else 0 end)
                    over (partition by conv_id order by k), 0) as shift
            from read where edit != 'D'
        ),
        written as (
            select conv_id, k, case when edit = 'K' then turn.role
                when (place - shift) % 2 = 1 then 'user' else 'assistant' end || ':'
                || case when edit = 'I' then '' else turn.text end as line
            from kept
        ),
        lines as (select conv_id, string_agg(line, chr(10) order by k) as body from written group by conv_id)
        select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
            coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
            coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
        from (select distinct conv_id from conversations) i
        left join judged j on j.conv_id is not distinct from i.conv_id
        left join lines l on l.conv_id is not distinct from i.conv_id
    """.replace("STEP", repair_inserts(f"list_transform([s.x], lambda x: {repair_step('n.row')})[1]")),
    "op13_importance": rf"""
        with crc as ({CRC_TABLE}),
        worded as (
            select doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
            from documents
        ),
        target as (
            select unnest(regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
            from benchmark
        ),
        in_docs as (select doc_id, unnest(w) as word, count(*) over () as total from worded),
        vocabulary as (select distinct word from (select word from in_docs union all select word from target)),
        bytes as (
            select word, hex(encode(word)) as h from vocabulary
        ),
        bucketed as (
            select word, {crc_of("h")} % 10000 as bucket
            from bytes, crc
        ),
        s as (select bucket, count(*) as n from in_docs join bucketed using (word) group by bucket),
        t as (select bucket, count(*) as n from target join bucketed using (word) group by bucket),
        gains as (
            select bucket, floor(1000 * ln(
                (coalesce(t.n, 0) + 1)::double * ((select count(*) from in_docs) + 10000)
                / ((s.n + 1)::double * ((select count(*) from target) + 10000))))::bigint as gain
            from s left join t using (bucket)
        ),
        sums as (
            select doc_id, count(*) as n, sum(gain)::bigint as total
            from in_docs join bucketed using (word) join gains using (bucket) group by doc_id
        ),
        scored as (
            select doc_id, coalesce(n, 0)::bigint as n_features,
                coalesce(floor(total / n), 0)::bigint as weight,
                ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
            from documents left join sums using (doc_id)
        ),
        final as (
            select doc_id, n_features, weight,
                (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint as score
            from scored
        ),
        places as (
            select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
            from final where n_features >= 20
        )
        select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank
        from final left join places using (doc_id)
    """,
}
