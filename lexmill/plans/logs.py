"""Training telemetry as queries: a user is a run, an event a logged value."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import telemetry
from lexmill.plans.registry import query
from lexmill.plans.shaping import STEPS
from lexmill.session import materialize, scratch_path
from lexmill.sources import scalars, tables


def events(spark, d):
    return tables.table(spark, d, "events")


def stored_steps(spark, d):
    """(run, step, value), written once: an ordered scan reads its input three times,
    and the numbering of the steps is itself one."""
    return materialize(scalars.run_steps(events(spark, d)).select("run", "step", "value"), "steps")


SCALARS = """sc AS (SELECT user_id AS run, event_type AS tag, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, "value" FROM events)"""


@query("s14_read_scalars", f'WITH {SCALARS} SELECT run, tag, step, "value" FROM sc')
def s14(spark, d):
    return scalars.read_scalars(events(spark, d))


@query(
    "s14_scalar_series",
    f"""WITH {SCALARS} SELECT run, tag, (step - 1) // 10000 AS part, count(*) AS n, array_to_string(list(step ORDER BY step), ',') AS steps,
        round(sum("value" * step), 4) AS weighted FROM sc GROUP BY 1, 2, 3""",
)
def s14b(spark, d):
    series = scalars.scalar_series(scalars.read_scalars(events(spark, d)))
    weighted = F.aggregate(F.zip_with("steps", "series", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return series.select(
        "run", "tag", "part", F.size("steps").cast("long").alias("n"),
        F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), F.round(weighted, 4).alias("weighted"),
    )


@query("s15_write_history", f'WITH {STEPS} SELECT run, step, tag, "value", event_id FROM steps')
def s15(spark, d):
    path = scratch_path(spark, "history")
    steps = scalars.run_steps(events(spark, d))
    scalars.write_history(steps.select("run", "step", "tag", "value", "event_id"), path)
    return scalars.read_history(spark, path).select("run", "step", "tag", "value", "event_id")


@query(
    "w1_decay",
    """WITH e AS (SELECT event_id, event_id % 40 AS t FROM events)
       SELECT event_id, CASE WHEN t < 3 THEN 1e-3 WHEN t < 7 THEN 1e-4 ELSE 1e-5 END AS manual,
       round(0.1 * pow(0.1, t / 20.0), 9) AS exponential, round(0.1 * pow(0.5, floor((1 + t) / 10.0)), 9) AS step,
       round(0.1 / (1 + 0.5 * t), 9) AS "time", 0.1::DOUBLE AS constant, round(0.1 + 0.02 * pow(0.5, 1 + t), 9) AS shrinking FROM e""",
)
def w1(spark, d):
    rows = events(spark, d).select("event_id", (F.col("event_id") % 40).alias("t"))
    out = telemetry.with_decay(rows, "manual", "t", 0.1, name="manual")
    out = telemetry.with_decay(out, "exponential", "t", 0.1, 20.0, name="exponential")
    out = telemetry.with_decay(out, "step", "t", 0.1, 0.5, 10.0, name="step")
    out = telemetry.with_decay(out, "time", "t", 0.1, 0.5, name="time")
    out = telemetry.with_decay(out, "constant", "t", 0.1, name="constant")
    out = telemetry.with_decay(out, "shrinking", "t", 0.1, name="shrinking").drop("t")
    return out.withColumns({c: F.round(c, 9) for c in ("exponential", "step", "time", "shrinking")})


@query(
    "w2_decay_per_n",
    f"""WITH {STEPS} SELECT run, step, CASE WHEN step < 4 THEN 0.1 ELSE round(0.1 * pow(0.1, (step // 4 - 1) / 20.0), 9) END AS exponential,
        CASE WHEN step < 4 THEN 0.1 ELSE round(0.1 / (1 + 0.5 * (step // 4 - 1)), 9) END AS "time" FROM steps""",
)
def w2(spark, d):
    steps = scalars.run_steps(events(spark, d)).select("run", "step")
    out = telemetry.with_decay_per_n(steps, "exponential", "step", 4, 0.1, 20.0, name="exponential")
    out = telemetry.with_decay_per_n(out, "time", "step", 4, 0.1, 0.5, name="time")
    return out.withColumns({c: F.round(c, 9) for c in ("exponential", "time")})


@query(
    "w3_step_history",
    """WITH t AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, "value" AS loss FROM events WHERE event_type <> 'purchase'),
       v AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, "value" AS val_loss,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS seconds FROM events WHERE event_type = 'purchase')
       SELECT t.run, t.step, loss, val_loss, seconds FROM t LEFT JOIN v ON t.run = v.run AND t.step = v.i * 3""",
)
def w3(spark, d):
    e = events(spark, d).withColumnRenamed("user_id", "run")
    train = telemetry.number_steps(e.where("event_type <> 'purchase'").select("run", "ts", "event_id", F.col("value").alias("loss")), "run", ["ts", "event_id"])
    seconds = F.get_json_object("props", "$.k").cast("double").alias("seconds")
    val = telemetry.number_steps(
        e.where("event_type = 'purchase'").select("run", "ts", "event_id", F.col("value").alias("val_loss"), seconds), "run", ["ts", "event_id"], "i"
    )
    return telemetry.step_history(train.drop("ts", "event_id"), val, 3).select("run", "step", "loss", "val_loss", "seconds")


MARKS = """m AS (SELECT user_id AS run, CASE WHEN event_type IN ('view', 'click') THEN 'epoch' ELSE 'validation' END AS phase,
  CASE WHEN event_type IN ('view', 'signup') THEN 'begin' ELSE 'end' END AS mark, ts, event_id FROM events WHERE event_type <> 'purchase')"""


@query(
    "w4_epoch_timing",
    f"""WITH {MARKS}, s AS (SELECT *, last_value(CASE WHEN mark = 'begin' THEN epoch_us(ts) END IGNORE NULLS) OVER w AS began,
          sum(CASE WHEN mark = 'end' THEN 1 ELSE 0 END) OVER w AS epoch FROM m WINDOW w AS (PARTITION BY run, phase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT run, phase, epoch::BIGINT AS epoch, round((epoch_us(ts) - began) / 1e6, 6) AS seconds FROM s WHERE mark = 'end' AND began IS NOT NULL""",
)
def w4(spark, d):
    kind = F.col("event_type")
    marks = events(spark, d).where(kind != "purchase").select(
        F.col("user_id").alias("run"),
        F.when(kind.isin("view", "click"), "epoch").otherwise("validation").alias("phase"),
        F.when(kind.isin("view", "signup"), "begin").otherwise("end").alias("mark"), "ts", "event_id",
    )
    return telemetry.epoch_timing(marks).withColumn("seconds", F.round("seconds", 6))


@query(
    "w5_final_metric",
    f"""WITH {STEPS} SELECT run, (step - 1) // 10 AS epoch, max(step) AS last_step, arg_max("value", step) AS final_value FROM steps GROUP BY 1, 2""",
)
def w5(spark, d):
    steps = scalars.run_steps(events(spark, d)).withColumn("epoch", F.floor((F.col("step") - 1) / 10))
    return telemetry.final_metric(steps, ["run", "epoch"])


@query(
    "w6_lr_finder",
    f"""WITH {STEPS}, l AS (SELECT run, step AS n, "value" AS loss FROM steps),
        sm AS (SELECT run, n, 0.02::DOUBLE * pow(0.98, n) * sum(loss * pow(0.98, -n)) OVER (PARTITION BY run ORDER BY n) / (1 - pow(0.98, n)) AS smooth FROM l),
        b AS (SELECT *, min(smooth) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sm),
        st AS (SELECT run, coalesce(min(n) FILTER (n > 1 AND smooth > 4 * best), max(n)) AS stop FROM b GROUP BY 1)
        SELECT run, n, round(ln(1e-10 * pow(pow(1e11, 1.0 / 3900), n - 1)), 6) AS log_lr, round(smooth, 6) AS smooth
        FROM sm JOIN st USING (run) WHERE n > 10 AND n < stop""",
)
def w6(spark, d):
    losses = stored_steps(spark, d).select("run", F.col("step").alias("n"), F.col("value").alias("loss"))
    return telemetry.lr_finder(losses).select("run", "n", F.round(F.log("lr"), 6).alias("log_lr"), F.round("smooth", 6).alias("smooth"))


@query(
    "w7_epoch_jumps",
    f"""WITH {STEPS}, l AS (SELECT run, step, "value" - lag("value") OVER (PARTITION BY run ORDER BY step) AS jump FROM steps)
        SELECT run, (step - 1) // 10 AS epoch, step, round(jump, 6) AS jump FROM l WHERE step % 10 = 1 AND step > 1""",
)
def w7(spark, d):
    return telemetry.epoch_jumps(stored_steps(spark, d), 10).withColumn("jump", F.round("jump", 6))
