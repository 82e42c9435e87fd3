"""Writing: files, staged commits with a ledger, and the checks that stop a bad transfer before it starts."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage, estimated_bytes

STRICT = ("numeric", "string", "temporal")
#: Bytes, by the planner's estimate, that one task writes into a folder.
FOLDER_BYTES = 256 << 20


class RefusedWrite(ValueError):
    """A write that would lose or damage data."""


def write_files(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", by: Sequence[str] = (), **options: str) -> None:
    """csv, json, parquet or orc; partitioned by ``by``. A partitioned write is shuffled by its folder and a salt. A folder gets as
    many salts as its share of the table has ``FOLDER_BYTES``, so a large one is written by many tasks, a small one by one."""
    if mode == "overwrite":
        refuse_empty(df, path)
    if by:
        df = _dealt_to_folders(df, by)
    writer = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}), **options)
    (writer.partitionBy(*by) if by else writer).save(path)


def _dealt_to_folders(df: DataFrame, by: Sequence[str]) -> DataFrame:
    sizes = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_rows")))
    rows, folders = sizes.agg(F.sum("_rows"), F.count("*")).first()
    if not rows:
        return df
    per_task = max(rows * FOLDER_BYTES // max(estimated_bytes(df), 1), 1)
    salts = F.ceil(F.col("_rows") / per_task)
    files = sizes.agg(F.sum(salts)).first()[0]
    plain = {c: f"_plain{i}" for i, c in enumerate(by)}
    # Every row finds its folder's salts; the table has one row per folder, and Spark sends it whole where it is small.
    sizes = sizes.select(*[F.col(c).alias(n) for c, n in plain.items()], salts.alias("_salts"))
    found = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in plain.items()])
    salt = F.pmod(F.xxhash64(*([c for c in df.columns if c not in by] or by)), F.col("_salts"))
    return df.join(sizes, found).withColumn("_salt", salt).repartition(int(files), *[F.col(c) for c in by], "_salt").select(*df.columns)


def refuse_empty(df: DataFrame, target: str) -> None:
    """An overwrite with no rows would delete everything that is there."""
    if df.isEmpty():
        raise RefusedWrite(f"refusing to overwrite {target} with an empty result; check the filter or append instead")


def refuse_empty_source(source: DataFrame, predicate: Column | None, fills_gaps: bool = False) -> None:
    """Stop before any work when the filter matches nothing (a request that fills gaps may well find none)."""
    rows = source if predicate is None else source.where(predicate)
    if not fills_gaps and rows.limit(1).isEmpty():
        raise RefusedWrite("the filter matches no rows of the source")


def staged_write(df: DataFrame, target: str, job: str, mode: str = "append") -> int:
    """Write aside, then commit by one ledger record; a repeated job is a no-op. Returns the committed row count.

    Tasks write a version folder that no reader looks at. The ledger record that names it is the commit, so a failure
    before it leaves the target untouched and a retry after it changes nothing. Records are numbered, and each number is
    taken by creating its file, which only one writer can do: of writers that commit at once, one gets the number, the
    others look at the ledger again and take a later one, or none if their job was committed meanwhile.
    """
    spark = df.sparkSession
    done = _committed(spark, target, job)
    if done is not None:
        return done
    version = f"{target}/versions/{uuid.uuid4().hex}"
    df.write.parquet(version)
    rows = spark.read.parquet(version).count()
    if rows == 0 and mode == "overwrite":
        raise RefusedWrite(f"refusing to overwrite {target} with an empty result")
    number = (ledger(spark, target).agg(F.max("number")).first()[0] or 0) + 1
    while not _claimed(spark, target, number, {"job": job, "number": number, "version": version, "mode": mode, "rows": rows}):
        done = _committed(spark, target, job)
        if done is not None:
            return done
        number += 1
    return rows


def _committed(spark: SparkSession, target: str, job: str) -> int | None:
    record = ledger(spark, target).where(F.col("job") == job).orderBy("number").first()
    return None if record is None else record["rows"]


def _claimed(spark: SparkSession, target: str, number: int, record: dict) -> bool:
    """Write the record with this number; False if another writer has it.

    On a local file system the finished record is linked to its name, elsewhere the name is created with overwriting forbidden.
    A writer lost between creating and closing leaves an empty record, which no reader counts.
    """
    content = json.dumps(record).encode()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/ledger/{number:012d}.json")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        name = system.makeQualified(path).toUri().getPath()
        folder = os.path.dirname(name)
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(draft, "wb") as file:
            file.write(content)
        try:
            os.link(draft, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = system.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(content)
    out.close()
    return True


LEDGER = "job string, number long, version string, mode string, rows long"


def ledger(spark: SparkSession, target: str) -> DataFrame:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{target}/ledger")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{target}/ledger")


def read_committed(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the last overwrite and of every append after it. Of records with the same job, the first counts."""
    records = sorted({r["job"]: r for r in reversed(ledger(spark, target).orderBy("number").collect())}.values(),
                     key=lambda r: r["number"])
    start = max((i for i, r in enumerate(records) if r["mode"] == "overwrite"), default=0)
    if not records:
        raise ValueError(f"nothing was committed to {target}")
    return spark.read.parquet(*[r["version"] for r in records[start:]])


def jdbc_staged_write(df: DataFrame, url: str, table: str, job: str, mode: str = "append", **options: str) -> None:
    """Staging table by parallel tasks, then one driver transaction: ledger check, optional clear, copy, ledger record."""
    spark = df.sparkSession
    if mode == "overwrite":
        refuse_empty(df, table)
    stage = f"stage_{uuid.uuid4().hex[:12]}"
    for name, t in df.dtypes:
        if t.startswith("interval"):
            raise RefusedWrite(f"{name} is a duration; store it as whole days or seconds")
    df.write.format("jdbc").option("url", url).option("dbtable", stage).options(**options).mode("errorifexists").save()
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    columns = ", ".join(df.columns)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        if not _table_there(connection, "transfer_ledger"):
            statement.executeUpdate("CREATE TABLE transfer_ledger (job VARCHAR(128) NOT NULL, target VARCHAR(256) NOT NULL, "
                                    "PRIMARY KEY (job, target))")
        ask = connection.prepareStatement("SELECT job FROM transfer_ledger WHERE job = ? AND target = ?")
        ask.setString(1, job)
        ask.setString(2, table)
        if not ask.executeQuery().next():
            if mode == "overwrite":
                statement.executeUpdate(f"DELETE FROM {table}")
            statement.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
            note = connection.prepareStatement("INSERT INTO transfer_ledger VALUES (?, ?)")
            note.setString(1, job)
            note.setString(2, table)
            note.executeUpdate()
        connection.commit()
        statement.executeUpdate(f"DROP TABLE {stage}")
        connection.commit()
    finally:
        connection.close()


def _table_there(connection, name: str) -> bool:
    found = connection.getMetaData().getTables(None, None, name.upper(), None)
    return bool(found.next()) or bool(connection.getMetaData().getTables(None, None, name, None).next())


def type_class(t: T.DataType) -> str:
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return "other"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "temporal"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, T.BinaryType):
        return "binary"
    return "numeric" if isinstance(t, T.NumericType) else "other"


def _plain(name: str) -> str:
    return name.strip().strip('"`[]').lower()


def missing_in_destination(result: DataFrame, destination: T.StructType) -> list[str]:
    """Result columns with no place to go; extra destination columns are fine. Case does not matter."""
    there = {_plain(f.name) for f in destination.fields}
    return [c for c in result.columns if _plain(c) not in there]


def type_conflicts(result: DataFrame, destination: T.StructType) -> list[tuple[str, str, str]]:
    """Columns that would fail on insert: numbers, text and times do not mix; other classes are not judged."""
    there = {_plain(f.name): type_class(f.dataType) for f in destination.fields}
    out = []
    for f in result.schema.fields:
        mine, theirs = type_class(f.dataType), there.get(_plain(f.name))
        if mine in STRICT and theirs in STRICT and mine != theirs:
            out.append((f.name, mine, theirs))
    return out


def create_table_sql(table: str, schema: T.StructType, dialect: str = "postgresql") -> str:
    """CREATE TABLE for a result schema; durations are refused."""
    pg = dialect in ("postgresql", "postgres")
    quote = '"' if pg else "`"

    def kind(f: T.StructField) -> str:
        t, c = f.dataType, type_class(f.dataType)
        if isinstance(t, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            raise RefusedWrite(f"{f.name} is a duration; store it as whole days or seconds")
        if c == "numeric":
            return "BIGINT" if isinstance(t, T.IntegralType) else ("DOUBLE PRECISION" if pg else "DOUBLE")
        if c == "boolean":
            return "BOOLEAN" if pg else "TINYINT(1)"
        if c == "temporal":
            return "DATE" if isinstance(t, T.DateType) else ("TIMESTAMP" if pg else "DATETIME")
        if c == "binary":
            return "BYTEA" if pg else "LONGBLOB"
        return "TEXT"

    if not schema.fields:
        raise ValueError("cannot create a table from an empty schema")
    clean = str.maketrans("", "", '"`')
    cells = ", ".join(f"{quote}{f.name.translate(clean)}{quote} {kind(f)}" for f in schema.fields)
    return f"CREATE TABLE {quote}{table.translate(clean)}{quote} ({cells})"


def transfer(
    source: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, job: str, mode: str = "append",
    predicate: Column | None = None, destination: T.StructType | None = None,
) -> int:
    """Read, transform, check, commit. The source filter runs first and reaches the scan."""
    refuse_empty_source(source, predicate)
    result = transform(source if predicate is None else source.where(predicate))
    if destination is not None:
        lost, clash = missing_in_destination(result, destination), type_conflicts(result, destination)
        if lost or clash:
            raise RefusedWrite(f"destination mismatch: no column for {lost}, type conflicts {clash}")
    return staged_write(result, target, job, mode)
