"""Dynamic programming and enumeration over tables whose size does not grow with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import combinat
from quarry.plans.base import query
from quarry.sources.tables import table


@query("""with it as (select n_name as name, (1 + n_nationkey % 7)::int as w, (length(n_name) + n_regionkey)::double as v, row_number() over (order by n_name) as k from nation),
    r as (with recursive t(k, best) as (select 0::bigint, list_transform(range(41), lambda c: 0::double)
        union all select it.k, list_transform(range(1, 42), lambda c: case when it.w < c then greatest(best[c], best[c - it.w] + it.v) else best[c] end) from t join it on it.k = t.k + 1)
        select arg_max(best[41], k) as value from t) select value from r""")
def knapsack(spark, sf_dir):
    items = table(spark, sf_dir, "nation").select("n_name", (1 + F.col("n_nationkey") % 7).alias("w"), (F.length("n_name") + F.col("n_regionkey")).alias("v"))
    return combinat.knapsack(items, "w", "v", 40, "n_name").select("value")


@query("""with recursive r(a, n) as (select 0, 0 union select a + c, n + 1 from r, (select unnest([4, 7, 13]) as c) where a + c <= 60),
    best as (select a, min(n) as n from r group by a)
    select p_size::int as amount, coalesce(n, -1)::bigint as coins from (select distinct p_size from part) left join best on a = p_size""")
def coin_change(spark, sf_dir):
    return combinat.coin_change(table(spark, sf_dir, "part").select("p_size").distinct(), "p_size", [4, 7, 13], 60)


@query("""with recursive q(r, cols) as (select 0, []::int[] union all select r + 1, list_append(cols, c::int) from q, range(6) t(c)
    where r < 6 and len(list_filter(list_transform(range(r), lambda i: case when cols[i + 1] = c or abs(cols[i + 1] - c) = r - i then 1 else 0 end), lambda x: x = 1)) = 0)
    select array_to_string(cols, ',') as board from q where r = 6""")
def n_queens(spark, sf_dir):
    return combinat.queens(spark, 6)


@query("""with n as (select list(r_name order by r_name) as xs from region), s as (select xs, unnest(range(32)) as bits from n)
    select coalesce(array_to_string(list_filter(list_transform(range(5), lambda i: case when (bits >> i) & 1 = 1 then xs[i + 1] end), lambda x: x is not null), ','), '') as subset from s""")
def power_set(spark, sf_dir):
    return combinat.power_set(table(spark, sf_dir, "region"), "r_name")


@query("""with recursive p(xs) as (select []::varchar[] union all select list_append(xs, r_name) from p, region where len(xs) < 5 and not list_contains(xs, r_name)) select array_to_string(xs, ',') as permutation from p where len(xs) = 5""")
def permutations(spark, sf_dir):
    return combinat.permutations(table(spark, sf_dir, "region"), "r_name", 5)


@query("""with recursive c(xs, rest, last) as (select []::int[], 15, 0 union all select list_append(xs, x), rest - x, x from c, (select unnest([2, 3, 5, 7]) as x) where x >= last and x <= rest)
    select array_to_string(xs, ',') as combination from c where rest = 0""")
def combination_sum(spark, sf_dir):
    return combinat.combination_sum(spark, [2, 3, 5, 7], 15)


BOARDS = [
    "53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79",
    "8..........36......7..9.2...5...7.......457.....1...3...1....68..85...1..9....4..",
    "55..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79",
]


_TOP = "(spot - 1) // 27 * 27 + (spot - 1) % 9 // 3 * 3"


@query(f"""with recursive b as (select unnest({BOARDS!r}) as board),
    ok as (select board from b where not exists (select 1 from range(81) x(i), range(81) y(j) where i < j and board[i + 1] <> '.' and board[i + 1] = board[j + 1] and (i // 9 = j // 9 or i % 9 = j % 9 or (i // 27 = j // 27 and i % 9 // 3 = j % 9 // 3)))),
    r(board, s, spot) as (select board, board, strpos(board, '.') from ok
        union all select board, n, strpos(n, '.') from (select board, substr(s, 1, spot - 1) || d || substr(s, spot + 1) as n from r, (select unnest(range(1, 10))::varchar as d)
            where spot > 0 and not contains(substr(s, (spot - 1) // 9 * 9 + 1, 9), d) and not contains(substr(s, {_TOP} + 1, 3) || substr(s, {_TOP} + 10, 3) || substr(s, {_TOP} + 19, 3), d)
            and len(list_filter(range(9), lambda i: s[(spot - 1) % 9 + 9 * i + 1] = d)) = 0))
    select b.board, min(s) as solution from b left join r on r.board = b.board and spot = 0 group by b.board""")
def sudoku(spark, sf_dir):
    return combinat.sudoku(spark.createDataFrame([(b,) for b in BOARDS], "board string"))
