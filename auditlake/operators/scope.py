"""Row-level scope of a principal, as semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.sources.tables import Domain


def members(d: Domain) -> DataFrame:
    """(user_id, project_id, role): each of the seven users manages the projects of their number and is a member of others."""
    rows = d.headers().select("project_id").distinct().withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(6))))
    role = F.when(F.col("project_id") % 7 == F.col("user_id"), "MANAGER").when((F.col("project_id") + F.col("user_id")) % 3 == 0, "MEMBER")
    return rows.withColumn("role", role).filter("role is not null")


def visible_to_finance(d: Domain, company: int) -> DataFrame:
    return d.headers().filter((F.col("company_id") == company) & (F.col("status") != "DRAFT")).select("id", "project_id", "status")


def visible_to_manager(d: Domain, user: int) -> DataFrame:
    mine = members(d).filter((F.col("user_id") == user) & (F.col("role") == "MANAGER")).select("project_id")
    return d.headers().filter("status <> 'DRAFT'").join(mine, "project_id", "left_semi").select("id", "project_id", "status")


def visible_to_employee(d: Domain, user: int) -> DataFrame:
    mine = members(d).filter(F.col("user_id") == user).select("project_id")
    return d.headers().filter(F.col("created_by") == user).join(mine, "project_id", "left_semi").select("id", "project_id", "status")


def approval_authority(d: Domain) -> DataFrame:
    """Documents in project review with each manager of their project, and whether the manager's limit covers them."""
    inv = d.invoices().filter("status = 'PROJECT_REVIEW'").select("id", "project_id", "currency", "grand_total")
    rows = inv.join(F.broadcast(d.limits()), ["project_id", "currency"])
    return rows.select("id", "user_id", "amount", F.coalesce(F.col("grand_total") <= F.col("amount"), F.lit(False)).alias("within"))


def approval_matrix(d: Domain) -> DataFrame:
    """One row for each manager, one column for each currency."""
    return d.limits().groupBy("user_id").pivot("currency", ["SAR", "AED", "USD"]).agg(F.first("amount")).select("user_id", F.col("SAR").alias("sar"), F.col("AED").alias("aed"), F.col("USD").alias("usd"))
