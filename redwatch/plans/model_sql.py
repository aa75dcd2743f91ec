"""SQL counterpart of the forest: sampling, growth, scores and calibration as blocks for DuckDB."""

from __future__ import annotations

from ..config import MODEL_FEATURES, PRODUCTION
from .fixture import SETTINGS
from .sql import BLOCKS

COLUMNS = ["feature_error_rate_5xx" if f == "error_rate_5xx" else f for f in MODEL_FEATURES]
WIDTH = len(COLUMNS)
TREES, SUBSAMPLE = SETTINGS.trees, SETTINGS.subsample


def _input(c: str) -> str:
    return f"CASE WHEN abs({c}) < 1e6 THEN floor({c} * 1e9 + 0.5) / 1e9 ELSE CAST({c} AS DOUBLE) END"


def _unit(digest: str, start: int = 1, digits: int = 13) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT) / CAST({16**digits} AS DOUBLE)"


def _mean_path(n: str) -> str:
    return (
        f"CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} "
        f"WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    )


INPUTS = "[" + ", ".join(_input(c) for c in COLUMNS) + "] AS x"
ROW_ID = "sha256(endpoint_id || '|' || CAST(epoch_us(time) AS VARCHAR)) AS row_id"


def _split(source: str, seed: int, how: str, keep: str) -> str:
    """Rows (window) or nodes (group) of ``source`` with the drawn feature ``f`` and ``cut``."""
    over = " OVER node_rows" if how == "window" else ""
    tail = " WINDOW node_rows AS (PARTITION BY tree, node)" if how == "window" else " GROUP BY tree, node, depth"
    lo = ", ".join(f"min(x[{i}]){over}" for i in range(1, WIDTH + 1))
    hi = ", ".join(f"max(x[{i}]){over}" for i in range(1, WIDTH + 1))
    return f"""
        SELECT *, CASE WHEN raw_cut >= hi[f] THEN lo[f] ELSE raw_cut END AS cut
        FROM (SELECT *, lo[f] + {_unit('digest', 9, 13)} * (hi[f] - lo[f]) AS raw_cut
        FROM (SELECT *, vary[1 + CAST(floor({_unit('digest', 1, 8)} * len(vary)) AS BIGINT)] AS f
        FROM (SELECT *, list_filter(range(1, {WIDTH + 1}), lambda i: hi[i] > lo[i]) AS vary
        FROM (SELECT {keep}, count(*){over} AS size, [{lo}] AS lo, [{hi}] AS hi,
                     md5('{seed}|' || tree || '|' || node) AS digest
              FROM {source}{tail}))))"""


def forest_blocks(prefix: str, train: str, seed: int = PRODUCTION.seed) -> str:
    """Register ``<prefix>_nodes``, the node table of a forest on the block ``train`` (row_id, x)."""
    p = prefix
    # lgamma gives the binomial law; a chance of one offers every row to every tree
    BLOCKS[f"{p}_chance"] = ((train,), f"""
        SELECT least(1.0, (2.0 * least({SUBSAMPLE}, n) + 64.0) / greatest(n, 1)) AS p, least({SUBSAMPLE}, n) AS per_tree,
               CAST(greatest(1, ceil(log2(greatest(2, least({SUBSAMPLE}, n))))) AS INTEGER) AS deepest
        FROM (SELECT count(*) AS n FROM {train})""")
    BLOCKS[f"{p}_steps"] = ((f"{p}_chance",), f"""
        SELECT sum(mass) OVER (ORDER BY k) AS below FROM (
          SELECT k, CASE WHEN p >= 1.0 THEN 0.0 ELSE exp(lgamma({TREES} + 1.0) - lgamma(k + 1.0) - lgamma({TREES} - k + 1.0)
                   + k * ln(p) + ({TREES} - k) * ln(greatest(1.0 - p, 1e-300))) END AS mass
          FROM range({TREES}) t(k), {p}_chance)""")
    BLOCKS[f"{p}_drawn"] = ((train, f"{p}_steps"), f"""
        SELECT row_id, count(*) FILTER (below <= u) AS drawn
        FROM (SELECT row_id, {_unit(f"md5(row_id || '|{seed}')")} AS u FROM {train}), {p}_steps GROUP BY row_id""")
    BLOCKS[f"{p}_offers"] = ((f"{p}_drawn",), f"""
        SELECT row_id, tree FROM {p}_drawn, range({TREES}) t(tree)
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY md5(row_id || '|' || tree || '|{seed + 1}'), tree) <= drawn""")
    BLOCKS[f"{p}_samples"] = ((train, f"{p}_offers", f"{p}_chance"), f"""
        SELECT tree, x FROM {p}_offers JOIN {train} USING (row_id), {p}_chance
        QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5(row_id || '|' || tree || '|{seed + 2}'), row_id) <= per_tree""")
    BLOCKS[f"{p}_grown"] = ((f"{p}_samples", f"{p}_chance"), f"""
        SELECT tree, x, CAST(0 AS BIGINT) AS node, 0 AS depth FROM {p}_samples
        UNION ALL
        SELECT tree, x, 2 * node + CASE WHEN x[f] <= cut THEN 1 ELSE 2 END, depth + 1
        FROM ({_split(f'{p}_grown', seed, 'window', 'tree, x, node, depth')})
        WHERE f IS NOT NULL AND depth < (SELECT deepest FROM {p}_chance)""")
    BLOCKS[f"{p}_nodes"] = ((f"{p}_grown", f"{p}_chance"), f"""
        SELECT tree, node, depth, size, f IS NULL OR depth >= deepest AS is_leaf,
               CASE WHEN f IS NULL OR depth >= deepest THEN -1 ELSE f - 1 END AS feature,
               CASE WHEN f IS NULL OR depth >= deepest THEN 0.0 ELSE cut END AS threshold,
               CAST(round_even((depth + {_mean_path('size')}) * 1e9, 0) AS BIGINT) AS path
        FROM ({_split(f'{p}_grown', seed, 'group', 'tree, node, depth')}), {p}_chance""")
    return f"{p}_nodes"


def score_blocks(prefix: str, rows: str, forest: str) -> str:
    """Register ``<prefix>_raw``: the score of each row (row_id, x) of the block ``rows`` by a forest."""
    p = prefix
    BLOCKS[f"{p}_walk"] = ((rows, f"{forest}_nodes"), f"""
        SELECT row_id, x, tree, CAST(0 AS BIGINT) AS node FROM {rows}, range({TREES}) t(tree)
        UNION ALL
        SELECT w.row_id, w.x, w.tree, 2 * w.node + CASE WHEN w.x[n.feature + 1] <= n.threshold THEN 1 ELSE 2 END
        FROM {p}_walk w JOIN {forest}_nodes n ON n.tree = w.tree AND n.node = w.node AND NOT n.is_leaf""")
    BLOCKS[f"{p}_raw"] = ((f"{p}_walk", f"{forest}_nodes", f"{forest}_chance"), f"""
        SELECT row_id, pow(2.0, -(total / (1e9 * {TREES})) / unit) AS raw
        FROM (SELECT w.row_id, CAST(sum(n.path) AS DOUBLE) AS total FROM {p}_walk w
              JOIN {forest}_nodes n ON n.tree = w.tree AND n.node = w.node AND n.is_leaf GROUP BY w.row_id),
             (SELECT {_mean_path('per_tree')} AS unit FROM {forest}_chance)""")
    return f"{p}_raw"


def calibrated(raw: str, low: str = "p50", high: str = "p99") -> str:
    return (
        f"CASE WHEN {high} - {low} < 1e-9 THEN 0.0 ELSE least(1.0, greatest(0.0, ({raw} - {low}) / ({high} - {low}))) END"
    )


BLOCKS["model_rows"] = (("derived",), f"SELECT endpoint_id, time, window_rows, {ROW_ID}, {INPUTS} FROM derived")
# cycles of the training matrix: the complete ones outside faults, with a long enough window
BLOCKS["train"] = (("model_rows", "usable", "injections"), """
    SELECT row_id, x FROM model_rows m SEMI JOIN usable u ON u.endpoint_id = m.endpoint_id AND u.time = m.time
    WHERE window_rows >= 3 AND NOT EXISTS (SELECT 1 FROM injections i WHERE m.time BETWEEN i.injected_at AND i.cleared_at)""")
forest_blocks("forest", "train")
score_blocks("forest_score", "model_rows", "forest")
BLOCKS["calibration"] = (("forest_score_raw", "train"), """
    SELECT quantile_cont(raw, 0.5) AS p50, quantile_cont(raw, 0.99) AS p99 FROM forest_score_raw SEMI JOIN train USING (row_id)""")
BLOCKS["ml"] = (("model_rows", "forest_score_raw", "calibration"), f"""
    SELECT endpoint_id, time, row_id, window_rows, raw AS raw_ml, CASE WHEN window_rows >= 3 THEN {calibrated('raw')} ELSE 0.0 END AS ml_norm
    FROM model_rows JOIN forest_score_raw USING (row_id), calibration""")
