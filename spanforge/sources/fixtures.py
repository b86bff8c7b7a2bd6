"""Texts derived from the relational tables, as one set of expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Derived:
    """A table and select lists applied one over the other."""

    table: str
    selects: tuple[tuple[str, ...], ...]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        for select in self.selects:
            df = df.selectExpr(*select)
        return df

    def sql(self) -> str:
        query = self.table
        for select in self.selects:
            query = f"(SELECT {', '.join(select)} FROM {query}) AS t"
        return f"SELECT * FROM {query}"


def pad(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


def derived(table: str, key: str, *selects: tuple[str, ...]) -> Derived:
    columns = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "part": "p_partkey"}
    return Derived(table, (((f"{columns[table]} AS k", *([key] if key else [])), *selects)))


_A, _B = pad("k % 10000", 4), pad("k * 7 % 10000", 4)
PHONES = derived("customer", "", ("k AS doc_id", f"""CASE k % 6 WHEN 0 THEN '연락처 010-' || {_A} || '-' || {_B} || ' 입니다.'
 WHEN 1 THEN 'tel 02-' || substr({_A}, 1, 3) || '-' || {_B} || ' ok' WHEN 2 THEN 'intl +82-10-' || {_A} || '-' || {_B} || ';'
 WHEN 3 THEN '공일공-' || {_A} || '-' || {_B} WHEN 4 THEN 'fax 031' || substr({_A}, 1, 3) || {_B} || '.' ELSE 'id 9010-' || {_A} || '-' || {_B} END AS text"""))

_BIRTH = f"{pad('year(o_orderdate) % 100', 2)} || {pad('month(o_orderdate)', 2)} || {pad('day(o_orderdate)', 2)} AS birth"
_SUM = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))
NUMBERS = derived("orders", _BIRTH, ("k", "birth", f"CAST(1 + k % 4 AS STRING) || {pad('k % 100000', 5)} AS serial"), ("k", "birth", "serial", "birth || serial AS d"),
                  ("k", "birth", "serial", f"CAST((11 - ({_SUM}) % 11) % 10 AS INT) AS good"), ("k", "birth", "serial", "CASE WHEN k % 4 = 2 THEN (good + 1) % 10 ELSE good END AS last"))
RRN = Derived("orders", (*NUMBERS.selects, ("k AS doc_id", """CASE k % 4 WHEN 0 THEN '주민번호 ' || birth || '-' || serial || CAST(last AS STRING) || ' 확인'
 WHEN 1 THEN 'rrn ' || birth || serial || CAST(last AS STRING) || '.' WHEN 2 THEN '번호 ' || birth || '-' || serial || CAST(last AS STRING)
 ELSE translate(birth, '0123456789', '공일이삼사오육칠팔구') || '-' || serial || CAST(last AS STRING) END AS text""")))
RRN_DIGITS = Derived("orders", (*NUMBERS.selects, ("k AS doc_id", "CASE WHEN k % 7 = 0 THEN birth || serial WHEN k % 7 = 1 THEN '99' || substr(birth, 3) || '9' || substr(serial, 2) || CAST(last AS STRING) WHEN k % 7 = 2 THEN substr(birth, 1, 2) || '0230' || serial || CAST(last AS STRING) ELSE birth || '-' || serial || CAST(last AS STRING) END AS value")))

_AREA, _GROUP, _SERIAL = pad("k * 37 % 1000", 3), pad("k % 25", 2), pad("k * 3 % 7000 * (k % 9)", 5)
SSN_VALUES = derived("orders", "", ("k AS doc_id", f"{_AREA} AS area", f"{_GROUP} AS grp", f"substr({_SERIAL}, 2) AS serial"))
SSN = Derived("orders", (*SSN_VALUES.selects, ("doc_id", "area", "grp", "serial", "CASE WHEN doc_id % 2 = 0 THEN 'ssn ' || area || '-' || grp || '-' || serial || ' end' ELSE 'no ' || area || grp || serial || ';' END AS text")))

DN = derived("customer", "", (f"k AS doc_id", f"""CASE k % 5 WHEN 0 THEN '면허 11-' || {pad('k % 100', 2)} || '-' || {pad('k', 6)} || '-20' WHEN 1 THEN 'dl 12 34  ' || {pad('k', 6)} || ' 56 x'
 WHEN 2 THEN 'n 13' || {pad('k', 10)} || ' y' WHEN 3 THEN 'zero 00-00-000000-00' ELSE 'long 1' || {pad('k', 14)} END AS text"""))
PN = derived("customer", "", ("k AS doc_id", f"""CASE k % 4 WHEN 0 THEN 'passport M' || {pad('k', 8)} || '.' WHEN 1 THEN '여권 AB' || {pad('k', 7)} || ' ok' WHEN 2 THEN 'ref ABC' || {pad('k', 7)} ELSE 'x M' || {pad('k', 9)} END AS text"""))
BN = derived("customer", "", ("k AS doc_id", f"""CASE k % 6 WHEN 0 THEN '계좌 110-' || {pad('k % 1000', 3)} || '-' || {pad('k', 6)} || ' 입금' WHEN 1 THEN '계좌 ' || {pad('k', 6)} || '-12-' || {pad('k * 3', 6)}
 WHEN 2 THEN 'card 4111 1111 1111 ' || {pad('k', 4)} WHEN 3 THEN '11-22-' || {pad('k', 4)} || '-' || {pad('k * 5', 5)} || ' 33-44-' || {pad('k', 6)} WHEN 4 THEN 'short 11-22-3333' ELSE '전화 010-' || {_A} || '-' || {_B} END AS text"""))
AN = derived("customer", "", ("k AS doc_id", "CAST(1 + k % 900 AS STRING) AS n", "CAST(k % 9 AS STRING) AS m"),
             ("doc_id", """CASE doc_id % 5 WHEN 0 THEN '서울특별시 강남구 테헤란로 ' || n || '-' || m WHEN 1 THEN '부산광역시 해운대구 우동 ' || n || '-' || m WHEN 2 THEN '경기 성남시 분당구' WHEN 3 THEN '서울시 관악구 청룡동' ELSE '파주군 금촌읍 금촌리 ' || n || '의' || m || '번지' END AS address""",
              "CASE doc_id % 5 WHEN 0 THEN ' 연락처: 02' WHEN 1 THEN ' 문의전화:' ELSE '' END AS tail"),
             ("doc_id", "CASE WHEN doc_id % 5 = 2 THEN '' ELSE address END AS address", "'주소: ' || address || tail AS text"))
ZERO_WIDTH = derived("customer", "", ("k AS doc_id", f"concat('a\u200btel 010-', substr({_A}, 1, 2), '\u200c', substr({_A}, 3), '-', {_B}, '\u2060 b') AS text"))
MAILS = derived("customer", "", ("k AS doc_id", "CASE k % 8 WHEN 0 THEN 'user' || CAST(k AS STRING) || '@mail.example.com' WHEN 1 THEN '.dot@example.com' WHEN 2 THEN 'a..b@example.com' WHEN 3 THEN 'nodomain@' WHEN 4 THEN 'x@-bad.com' WHEN 5 THEN 'x@one' WHEN 6 THEN 'u' || CAST(k AS STRING) || '@a-b.co' ELSE 'none' END AS value"))
ADDRESSES = derived("customer", "", ("k AS doc_id", "CASE k % 9 WHEN 0 THEN '10.' || CAST(k % 300 AS STRING) || '.2.3' WHEN 1 THEN '0.0.0.0' WHEN 2 THEN '255.255.255.255' WHEN 3 THEN '2001:db8::1' WHEN 4 THEN '::' WHEN 5 THEN '1:2:3:4:5:6:7:8' WHEN 6 THEN '1:2:3' WHEN 7 THEN '01.2.3.4' ELSE 'fe80::1::2' END AS value"))
TABLES = derived("customer", "", ("k AS doc_id", f"""CASE k % 3 WHEN 0 THEN 'Name' || chr(9) || 'Passport' || chr(9) || 'Total' || chr(10) || 'kim' || chr(9) || 'M' || {pad('k', 8)} || chr(9) || '17' || chr(10)
 WHEN 1 THEN 'Name   Passport No   Total' || chr(10) || 'lee    M' || {pad('k', 8)} || '      17' ELSE 'note 4' || chr(10) || 'Name Passport' || chr(10) || '12 34' || chr(10) || 'park M' || {pad('k', 8)} END AS text"""))
#: Spans with overlaps, as rows: document, start, end.
INTERVALS = Derived("lineitem", (("l_orderkey AS doc_id", "CAST(l_linenumber * 7 + l_partkey % 11 AS INT) AS s", "CAST(l_linenumber * 7 + l_partkey % 11 + 1 + l_suppkey % 13 AS INT) AS e", "l_linenumber AS n"),))
