"""Task history, diffs and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.catalog.base import add
from codefacts.catalog.joins import EVIDENCE, evidence_rows, verdict_checks
from codefacts.operators import decisions, diffs, timeline
from codefacts.operators.scan import seq_bucket
from codefacts.projection import Facts

STATES = ["CREATED", "PLANNING", "EXECUTING", "REVIEWING", "VERIFYING", "DECIDING", "REPAIRING", "EXECUTING", "COMPLETED"]
PAIRS = {
    "runs": """select *, sum(case when type='ToolStarted' then 1 else 0 end) over w as s, sum(case when type='ToolFinished' then 1 else 0 end) over w as fn from ev
      where type in ('ToolStarted','ToolFinished') window w as (partition by task_id order by seq)""",
    "drops": "select *, greatest(0, max(fn - s) over (partition by task_id order by seq)) as d from runs",
    "valid": "select *, coalesce(lag(d) over (partition by task_id order by seq), 0) as dp from drops",
    "pairs": """select a.task_id, a.seq as start_seq, b.seq as end_seq, a.ts as start_ts, a.payload as start_payload, b.payload as end_payload from valid a join valid b on b.task_id=a.task_id and b.type='ToolFinished' and b.d=b.dp and b.fn-b.d=a.s where a.type='ToolStarted'""",
    "moves": f"""select *, {STATES}[cast(floor(value) as bigint) % 9 + 1] as to_s, {STATES}[cast(floor(value*7) as bigint) % 9 + 1] as from_s from ev where type='TaskStateChanged'""",
}


def moves(f: Facts):
    names = F.array(*[F.lit(s) for s in STATES])
    at = lambda v: F.element_at(names, (F.floor(v) % 9 + 1).cast("int"))
    rows = f.events.where("type = 'TaskStateChanged'")
    return rows.withColumn("to", at(F.col("value"))).withColumn("from", at(F.col("value") * 7))


@add("w8_pair_tool_events", "select task_id, start_seq, end_seq from pairs", PAIRS)
def w8(f: Facts):
    return timeline.pair_tool_events(f.events, block=500).select("task_id", "start_seq", "end_seq")


@add("w7_build_timeline", """
select task_id, key, kind, sender, content, row_number() over (partition by task_id order by ts, key) - 1 as seq from (
 select task_id, ts, concat('e:',seq) as key, 'evidence' as kind, 'system' as sender, concat('run ',seq,' exit=',cast(floor(value) as bigint) % 2) as content from ev where type='TestFinished'
 union all select task_id, start_ts, concat('ev:',start_seq), 'tool', null, coalesce(json_extract_string(end_payload,'$.tool'),json_extract_string(start_payload,'$.tool'),'') from pairs
 union all select task_id, ts, concat('ev:',seq), 'state', 'system', 'None → None' from ev where type='TaskStateChanged'
 union all select conv_id, timestamp '2024-01-02' + to_minutes(cast(turn*1000 as bigint)), concat('m:',conv_id,'-',turn), 'message', role, text from conversations)""", PAIRS)
def w7(f: Facts):
    ev = f.events.where("type = 'TestFinished'").select("project_id", "task_id", F.col("seq").alias("id"), F.col("ts").alias("timestamp"),
                                                        F.concat(F.lit("run "), F.col("seq").cast("string")).alias("command"), (F.floor("value") % 2).alias("exit_code"))
    start = F.lit("2024-01-02 00:00:00").cast("timestamp")
    msg = f.messages.select("project_id", "task_id", F.concat_ws("-", "task_id", "ord").alias("id"), "sender", "content",
                            F.timestamp_seconds(F.unix_timestamp(start) + F.col("ord") * 60000).alias("created_at"))
    return timeline.build_timeline(messages=msg, evidence=ev, events=f.events, block=500).select("task_id", "key", "kind", "sender", "content", "seq")


@add("w9_replay_task_state", """
select m.task_id, max_by(to_s, seq) as state, count(*) filter (where from_s='REPAIRING' and to_s='EXECUTING') as iteration, max(seq) as last_seq from moves m
 left join (select task_id, min(seq) as e from moves where to_s='COMPLETED' group by task_id) x on x.task_id=m.task_id where x.e is null or m.seq<=x.e group by m.task_id""", PAIRS)
def w9(f: Facts):
    return timeline.replay_task_state(moves(f)).drop("project_id")


@add("w10_recent_events", "select task_id, seq, type from (select *, row_number() over (partition by task_id order by seq desc) as r from ev) where r <= 20")
def w10(f: Facts):
    return timeline.recent_per_task(f.events).select("task_id", "seq", "type")


@add("w10_recent_tasks", "select task_id, max(ts) as updated_at from ev group by task_id order by 2 desc, 1 limit 20")
def w10t(f: Facts):
    return timeline.recent_tasks(f.events).drop("project_id")


@add("w10_replay_after", "select e.task_id, e.seq, e.type from ev e where e.seq > 5000")
def w10a(f: Facts):
    return timeline.replay_events(f.events, 5000).select("task_id", "seq", "type")


@add("w11_budget_pack", """
select doc_id, how, kept from (select doc_id, case when s <= 60000 and s-n < 60000 then 'full' when s > 60000 and s-n < 60000 then 'cut' else 'note' end as how, case when s <= 60000 then n when s-n < 60000 then greatest(60000-(s-n)-120,0) else 0 end as kept
 from (select doc_id, length(text) as n, sum(length(text)) over (partition by source order by doc_id) as s from documents))""")
def w11(f: Facts):
    docs = f.table("documents").select("source", "doc_id", "text")
    return timeline.budget_pack(docs, ["source"], seq_bucket("doc_id", 200), ["doc_id"]).select("doc_id", "how", "kept")


@add("w15_last_message", "select conv_id as task_id, role as sender, max_by(text, turn) as content from conversations group by all")
def w15(f: Facts):
    return timeline.last_message(f.messages).drop("project_id")


@add("a20_task_decision", """
select t.task_id, case when coalesce(f.n,0) > 0 or v.task_id is null or v.bad or coalesce(c.n,0) > 0 or t.iteration >= 5 then 'FAIL' else 'PASS' end as outcome, coalesce(f.n,0) as open_blockers,
 case when v.task_id is null then 0 else coalesce(c.n,0) end as failed_checks, v.task_id is not null as has_verdict
from (select c_custkey as task_id, c_custkey % 6 as iteration from customer) t
left join (select o_custkey as task_id, count(*) filter (where o_orderpriority in ('1-URGENT') and o_orderstatus='F') as n from orders group by 1) f on f.task_id=t.task_id
left join (select o_custkey as task_id, bool_or(o_orderpriority='5-LOW' and o_totalprice > 400000) as bad from orders group by 1) v on v.task_id=t.task_id
left join (select c.task_id, count(*) as n from chk c left join (select check_id, cast(b[2] as integer) as exit_code from found where not (b[3]='3' and b[2] <> '0')) e on e.check_id=c.check_id where c.required and coalesce(e.exit_code,1) <> 0 group by c.task_id) c on c.task_id=t.task_id""", EVIDENCE)
def a20(f: Facts):
    p = F.lit("firmware").alias("project_id")
    o = f.table("orders")
    tasks = f.table("customer").select(p, F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 6).alias("iteration"), F.lit(5).alias("max_iterations"))
    findings = o.select(p, F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").otherwise("LOW").alias("severity"), F.when(F.col("o_orderstatus") == "F", "OPEN").otherwise("RESOLVED").alias("status"))
    verdicts = o.select(p, F.col("o_custkey").alias("task_id"), F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 400000), "FAIL").otherwise("PASS").alias("conclusion"))
    return decisions.task_decision(tasks, findings, verdicts, verdict_checks(f), evidence_rows(f)).drop("project_id")


def diff_rows(f: Facts):
    """One diff per part: it edits the part's file, adds a header, touches a build file or only a comment."""
    k = F.col("ord")
    head = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n@@ -"), (F.col("start_line") - 1).cast("string"), F.lit(",3 +1,3 @@\n context\n"))
    body = (
        F.when(k % 6 == 0, F.lit("-old line\n+new line")).when(k % 6 == 1, F.lit("+// note\n-  /* gone */\n+}"))
        .when(k % 6 == 2, F.concat(F.lit("+#include \"x.h\"\n-a;"))).when(k % 6 == 3, F.concat(F.lit("+a;\ndiff --git a/n"), k.cast("string"), F.lit(".c b/n"), k.cast("string"), F.lit(".c\nnew file mode 100644\n+++ b/n.c\n+x")))
        .when(k % 6 == 4, F.lit("+a;\ndiff --git a/Makefile b/Makefile\n@@ -1 +1 @@\n-x\n+y")).otherwise(F.lit(" more\n-late line"))
    )
    return f.symbols.select("project_id", k.alias("diff_id"), F.concat(head, body).alias("diff"), "file", "start_line")


@add("q23_classify_diff", """
select ord as diff_id, case ord % 6 when 0 then 'L2' when 1 then 'L2' when 2 then 'L3' when 3 then 'L3' when 4 then 'L4' else case when exists (select 1 from sym b where b.file=s.file and b.start_line=s.start_line+1) then 'L2' else 'L1' end end as level,
 case when ord % 6 in (0,1,2) then 1 when ord % 6 = 5 and exists (select 1 from sym b where b.file=s.file and b.start_line=s.start_line+1) then 1 else 0 end as touched, case when ord % 6=3 then 1 else 0 end as new_files from sym s""")
def q23(f: Facts):
    return diffs.classify_diff(diff_rows(f), f.symbols).drop("project_id")


@add("q23_diff_files", """
select ord as diff_id, file, 'modified' as change from sym union all select ord, concat('n',ord,'.c'), 'added' from sym where ord % 6=3 union all select ord, 'Makefile', 'modified' from sym where ord % 6=4""")
def q23f(f: Facts):
    return diffs.diff_files(diffs.diff_lines(diff_rows(f))).drop("project_id")


@add("q24_comment_only", "select ord as diff_id, ord % 6 = 1 as comment_only from sym")
def q24(f: Facts):
    return diffs.comment_only(diff_rows(f)).drop("project_id")


@add("s20_read_diff", "select doc_id as diff_id, length(text) as chars, length(text) > 8000 as exceeds, md5(text) as h from documents")
def s20(f: Facts):
    d = f.table("documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("diff_id"), F.col("text").alias("diff"))
    return diffs.read_diff(d).select("diff_id", "chars", "exceeds", F.md5("diff").alias("h"))


@add("t7_job_states", """
select user_id as job_id, case when last='running' and date_diff('second', mn, timestamp '2024-01-30 00:00:00') > 3600 then 'failed' else last end as status,
 case when last='running' and date_diff('second', mn, timestamp '2024-01-30 00:00:00') > 3600 then 'timeout' when last='scope_required' then 'waiting_scope_confirmation' when last='completed' then 'completed' when last='failed' then 'error' else 'building_index' end as phase
from (select user_id, min(ts) as mn, max_by(case event_type when 'click' then 'running' when 'view' then 'scope_required' when 'error' then 'failed' else 'completed' end, event_id) as last from events group by user_id)""")
def t7(f: Facts):
    t = F.col("event_type")
    ev = f.table("events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
                                  F.when(t == "click", "running").when(t == "view", "scope_required").when(t == "error", "failed").otherwise("completed").alias("status"))
    return timeline.job_states(ev, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("job_id", "status", "phase")
