"""The derivations of `inputs.py` as DuckDB CTEs, and a composer for oracle queries."""

from __future__ import annotations

from workload import inputs


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


CTES: dict[str, tuple[list[str], str]] = {
    "inv_base": (
        [],
        """
SELECT l_orderkey AS order_key, l_suppkey AS supp_key,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS line_total, count(*) AS n_lines,
       any_value(CAST(o_orderdate AS DATE)) AS invoice_date, any_value(c_name) AS customer, any_value(s_name) AS vendor
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
     JOIN supplier ON s_suppkey = l_suppkey
GROUP BY l_orderkey, l_suppkey""",
    ),
    "inv_sums": (
        ["inv_base"],
        """
SELECT *, CAST(CASE WHEN order_key % 17 = 0 THEN 0 WHEN order_key % 7 = 0 THEN line_total + 1.00
                    WHEN order_key % 19 = 0 THEN line_total + 0.01 WHEN order_key % 23 = 0 THEN line_total + 0.02
                    ELSE line_total END AS DECIMAL(18,2)) AS subtotal,
       CAST(line_total * CAST(0.07 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS tax,
       'INV-' || CASE WHEN length(CAST(order_key AS VARCHAR)) >= 8 THEN CAST(order_key AS VARCHAR)
                      ELSE lpad(CAST(order_key AS VARCHAR), 8, '0') END || '-' || CAST(supp_key AS VARCHAR) AS number
FROM inv_base""",
    ),
    "inv": (
        ["inv_sums"],
        """
SELECT order_key * 10000000 + supp_key AS ord, 'inbox/' || number || '.pdf' AS path, order_key, supp_key,
       CASE WHEN order_key % 13 <> 0 THEN number END AS invoice_number, invoice_date,
       CASE WHEN order_key % 11 = 0 THEN invoice_date - 1 ELSE invoice_date + 30 END AS due_date,
       CASE WHEN order_key % 5 <> 0 THEN 'PO-' || substr(number, 5, strpos(substr(number, 5), '-') - 1) END AS po_number,
       (order_key % 101) / 100.0::DOUBLE AS confidence, vendor, customer, subtotal, tax,
       CAST(subtotal + tax + CASE WHEN order_key % 29 = 0 THEN 0.05 ELSE 0 END AS DECIMAL(18,2)) AS total_amount,
       CASE order_key % 3 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS currency, line_total, n_lines
FROM inv_sums""",
    ),
    "po": (
        [],
        """
SELECT 'PO-' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 8 THEN CAST(o_orderkey AS VARCHAR)
                     ELSE lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS po_number
FROM orders WHERE o_orderstatus <> 'P'""",
    ),
    "agr_base": (
        [],
        """
SELECT s_suppkey AS k, s_name AS vendor, slot,
       DATE '1995-01-01' + CAST((s_suppkey * 37 + slot * 700) % 2000 AS INTEGER) AS effective_date
FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS s(slot)""",
    ),
    "agr": (
        ["agr_base"],
        f"""
SELECT k * 3 + slot AS ord, 'AGR-' || k || '-' || slot AS agreement_id,
       'contracts/AGR-' || k || '-' || slot || '.pdf' AS path,
       CASE WHEN (k + slot) % 9 < 8 THEN ({sql_list(inputs.AGREEMENT_TYPES)})[CAST((k + slot) % 9 + 1 AS INTEGER)] END
         AS agreement_type,
       effective_date,
       CASE WHEN (k * 3 + slot) % 11 = 0 THEN effective_date - 10
            WHEN (k * 3 + slot) % 7 = 5 THEN DATE '9999-12-31'
            ELSE effective_date + CAST(365 * (1 + (k + slot) % 6) AS INTEGER) END AS expiry_date,
       vendor, 'Customer#' || lpad(CAST(k * 10 AS VARCHAR), 9, '0') AS client, (k + slot) % 9 = 4 AS single_party,
       CAST(((k * 7919 + slot * 104729) % 40 + 1) * 1000000 AS DECIMAL(18,2)) AS cap
FROM agr_base""",
    ),
    "scored": (
        [],
        f"""
SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN ({sql_list(inputs.RESULT_TYPES)})[CAST(doc_id % 6 + 1 AS INTEGER)] END
         AS document_type,
       (doc_id % 101) / 100.0::DOUBLE AS confidence, n_chars % 5000 AS duration_ms, doc_id % 17 = 0 AS failed,
       doc_id % 4 = 1 AS cache_hit
FROM documents""",
    ),
    "attempts": (
        [],
        """
SELECT doc_id, attempt, ((doc_id * 31 + attempt * attempt * 7) % 11) / 10.0::DOUBLE AS confidence,
       'v-' || doc_id || '-' || attempt AS value, n_chars
FROM documents CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt)""",
    ),
    "attempt_fields": (
        ["attempts"],
        f"""
SELECT doc_id, attempt, field,
       CASE WHEN (doc_id + attempt + i) % 7 <> 0 THEN field || '-' || doc_id || '-' || attempt END AS value,
       ((doc_id * 13 + attempt * 5 + i * 3) % 10) / 10.0::DOUBLE AS confidence
FROM attempts CROSS JOIN (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(inputs.FIELDS))}) AS f(i, field)""",
    ),
    "file_rows": (
        [],
        """
SELECT o_orderkey, o_custkey, i, CAST(o_orderkey // 3 AS VARCHAR) AS g, o_orderkey % 4 AS m
FROM orders CROSS JOIN (VALUES (0), (1)) AS t(i)""",
    ),
    "files": (
        ["file_rows"],
        """
SELECT o_orderkey * 2 + i AS ord,
       CASE WHEN m = 0 AND i = 0 THEN 'a/INV-' || g || '.pdf' WHEN m = 0 THEN 'b/INV_' || g || '.pdf'
            WHEN m = 1 AND i = 0 THEN 'a/INV-' || g || '.pdf' WHEN m = 1 THEN 'c/PO-' || g || '.pdf'
            WHEN m = 2 AND i = 0 THEN 'x/invoice-' || g || '.pdf' WHEN m = 2 THEN 'y/invoice_' || g || '_part1.pdf'
            WHEN o_orderkey % 8 = 3 AND i = 0 THEN 'deal' || o_orderkey || '_part1.pdf'
            WHEN o_orderkey % 8 = 3 THEN 'deal' || o_orderkey || '-part-2.pdf'
            WHEN i = 0 THEN 'Deal' || o_orderkey || '_v1.pdf' ELSE 'deal' || o_orderkey || '-v2.pdf' END
         AS path,
       'Vendor ' || (o_orderkey % 97) AS vendor, 'Client ' || (o_custkey // 2) AS customer
FROM file_rows""",
    ),
    "paths": (
        [],
        f"""
SELECT o_orderkey,
       'in/' || ({sql_list(inputs.STEMS)})[CAST(o_orderkey % {len(inputs.STEMS)} + 1 AS INTEGER)] || '_' || o_orderkey ||
         ({sql_list(inputs.SUFFIXES)})[CAST((o_orderkey // 7) % {len(inputs.SUFFIXES)} + 1 AS INTEGER)] AS path,
       ({sql_list(inputs.HINTS)})[CAST((o_orderkey // 5) % {len(inputs.HINTS)} + 1 AS INTEGER)] AS hint
FROM orders""",
    ),
}


def oracle(body: str, *needs: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """`WITH` prelude for the named derivations (and their own), then `extra` CTEs, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered]
    parts += [f"{n} AS ({q.strip()})" for n, q in (extra or {}).items()]
    prelude = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return prelude + body.strip()
