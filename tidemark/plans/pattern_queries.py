"""Event patterns over all transactions, with limits scaled to the data."""

from pyspark.sql import functions as F

from tidemark.operators import patterns as P
from tidemark.plans.registry import query
from tidemark.sources.adapters import transactions

_ROW = """t."transactionId", t."userId", t.ts, t.amount, t.status, CAST(t."riskScore" AS DOUBLE) AS "riskScore",
  t.country, t."merchantCategory", t."isFraud" """


@query("c1_velocity", f"""
WITH t AS (
  SELECT *, lead(ts, 4) OVER w AS e, lead("transactionId", 4) OVER w AS eid,
    sum(amount) OVER (PARTITION BY "userId" ORDER BY ts, "transactionId"
      ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS total
  FROM transactions WHERE status = 'completed'
  WINDOW w AS (PARTITION BY "userId" ORDER BY ts, "transactionId"))
SELECT {_ROW}, ts AS "startTs", e AS "endTs", eid AS "endId", round(total, 6) AS "allTotal"
FROM t WHERE e - ts < INTERVAL 1 day
""")
def c1_velocity(spark, folder):
    return P.velocity(transactions(spark, folder), within="1 day")


@query("c2_structuring", f"""
WITH smalls AS (SELECT * FROM transactions WHERE status = 'completed' AND amount <= 100),
hits AS (
  SELECT h."transactionId" AS hid, s.ts, s."transactionId", s.amount,
    row_number() OVER (PARTITION BY h."transactionId" ORDER BY s.ts, s."transactionId") AS r
  FROM transactions h JOIN smalls s ON h."userId" = s."userId" AND s.ts > h.ts AND s.ts < h.ts + INTERVAL 5 day
  WHERE h.status = 'completed' AND h.amount >= 1000),
done AS (
  SELECT hid, max(ts) AS e, arg_max("transactionId", ts) AS eid, sum(amount) AS total
  FROM hits WHERE r <= 3 GROUP BY hid HAVING count(*) = 3)
SELECT {_ROW}, t.ts AS "startTs", e AS "endTs", eid AS "endId", t.amount AS "highTotal",
  round(total, 6) AS "smallTotal"
FROM done JOIN transactions t ON t."transactionId" = hid
""")
def c2_structuring(spark, folder):
    return P.structuring(transactions(spark, folder), within="5 days")


@query("c3_country_change", f"""
WITH t AS (
  SELECT *, lead(ts) OVER w AS e, lead("transactionId") OVER w AS eid, lead(country) OVER w AS nc
  FROM transactions WHERE status = 'completed'
  WINDOW w AS (PARTITION BY "userId" ORDER BY ts, "transactionId"))
SELECT {_ROW}, nc AS "nextCountry", e AS "endTs", eid AS "endId"
FROM t WHERE e - ts < INTERVAL 6 hour AND nc <> country
""")
def c3_country_change(spark, folder):
    return P.country_change(transactions(spark, folder), "6 hours")


@query("c4_card_testing", f"""
WITH f AS (
  SELECT "transactionId", "userId", ts, lead(ts, 2) OVER w AS third,
    sum(amount) OVER (PARTITION BY "userId" ORDER BY ts, "transactionId"
      ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS total
  FROM transactions WHERE status = 'failed'
  WINDOW w AS (PARTITION BY "userId" ORDER BY ts, "transactionId")),
done AS (
  SELECT f."transactionId" AS fid, any_value(f.total) AS total, min(s.ts) AS e,
    arg_min(s."transactionId", s.ts) AS eid, arg_min(s.amount, s.ts) AS stotal
  FROM f JOIN transactions s ON f."userId" = s."userId" AND s.status = 'completed' AND s.ts > f.third
    AND s.ts < f.ts + INTERVAL 72 hour
  GROUP BY f."transactionId")
SELECT {_ROW}, t.ts AS "startTs", e AS "endTs", eid AS "endId", round(total, 6) AS "failedTotal",
  stotal AS "successTotal"
FROM done JOIN transactions t ON t."transactionId" = fid
""")
def c4_card_testing(spark, folder):
    return P.card_testing(transactions(spark, folder), within="72 hours")


@query("c5_off_hours", f"""
SELECT {_ROW} FROM transactions t
WHERE (hour(ts) >= 22 OR hour(ts) <= 6) AND "riskScore" >= 0.7 AND status = 'completed'
""")
def c5_off_hours(spark, folder):
    return P.off_hours(transactions(spark, folder))


@query("c6_sequence", f"""
WITH a AS (SELECT * FROM transactions WHERE amount >= 500),
b AS (
  SELECT a."transactionId" AS aid, b.ts, b.amount,
    row_number() OVER (PARTITION BY a."transactionId" ORDER BY b.ts) AS r
  FROM a JOIN transactions b ON a."userId" = b."userId" AND b.status = 'failed' AND b.ts > a.ts
    AND b.ts < a.ts + INTERVAL 5 day),
bb AS (SELECT aid, max(ts) AS bts, sum(amount) AS btotal FROM b WHERE r <= 2 GROUP BY aid HAVING count(*) = 2),
c AS (
  SELECT aid, any_value(btotal) AS btotal, c.ts, c."transactionId", c.amount,
    row_number() OVER (PARTITION BY aid ORDER BY c.ts) AS r
  FROM bb JOIN a ON a."transactionId" = aid
    JOIN transactions c ON c."userId" = a."userId" AND c.amount < 100 AND c.ts > bts
      AND c.ts < a.ts + INTERVAL 5 day
  GROUP BY aid, c.ts, c."transactionId", c.amount),
cc AS (
  SELECT aid, any_value(btotal) AS btotal, sum(amount) AS ctotal, max(ts) AS e, arg_max("transactionId", ts) AS eid
  FROM c WHERE r <= 2 GROUP BY aid HAVING count(*) = 2)
SELECT {_ROW}, t.ts AS "startTs", e AS "endTs", eid AS "endId", t.amount AS "largeTotal",
  round(btotal, 6) AS "failedTotal", round(ctotal, 6) AS "smallTotal"
FROM cc JOIN transactions t ON t."transactionId" = aid
""")
def c6_sequence(spark, folder):
    pattern = (P.Pattern.begin("large").where(F.col("amount") >= 500)
               .followed_by("failed").where(F.col("status") == "failed").times(2)
               .followed_by("small").where(F.col("amount") < 100).times(2).within("5 days"))
    return pattern.select(transactions(spark, folder), "userId", "transactionId")
