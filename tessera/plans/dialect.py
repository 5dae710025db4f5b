"""One query text for two engines: what Spark and DuckDB write differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    def words(self, x: str) -> str:
        return rf"filter(split({x}, '[ \\t\\n\\r\\f\\v]+'), w -> w <> '')"

    def words_head(self, x: str, n: int) -> str:
        """The first ``n`` words: splitting stops behind them, and only a first part can be empty."""
        return rf"slice(filter(split({x}, '[ \\t\\n\\r\\f\\v]+', {n + 2}), w -> w <> ''), 1, {n})"

    def any_word(self, x: str) -> str:
        return rf"rlike({x}, '[^ \\t\\n\\r\\f\\v]')"

    def lines(self, x: str) -> str:
        return rf"filter(transform(split({x}, '\\n'), l -> trim(l)), l -> l <> '')"

    def raw_lines(self, x: str) -> str:
        """Lines as they are, without blank ones."""
        return rf"filter(split({x}, '\\n'), l -> trim(l) <> '')"

    def grams(self, words: str, n: int) -> str:
        """Joined n-grams of a list of words; of fewer words, none."""
        return f"case when size({words}) >= {n} then transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')) else cast(array() as array<string>) end"

    def each(self, x: str) -> str:
        return f"explode({x})"

    def once(self, x: str) -> str:
        """``x`` as a column of its own: a generator keeps the optimiser from computing it anew at each use."""
        return f"explode(array({x}))"

    def list(self, items: str) -> str:
        return f"array({items})"

    def size(self, x: str) -> str:
        return f"cast(size({x}) as bigint)"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def where(self, x: str, v: str, cond: str) -> str:
        return f"filter({x}, {v} -> {cond})"

    def map(self, x: str, v: str, to: str) -> str:
        return f"transform({x}, {v} -> {to})"

    def head(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def total(self, x: str) -> str:
        return f"aggregate({x}, cast(0 as bigint), (a, v) -> a + v)"

    def least(self, x: str) -> str:
        return f"array_min({x})"

    def range(self, a: str, b: str) -> str:
        """a to b, both included; empty where b < a."""
        return f"case when {b} >= {a} then sequence(cast({a} as bigint), cast({b} as bigint)) else cast(array() as array<bigint>) end"

    def overlap(self, a: str, b: str) -> str:
        return f"cast(size(array_intersect({a}, {b})) as bigint)"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, r'{pattern}') as bigint)"

    def letters(self, x: str, inside: str) -> str:
        """How many characters are of a class: what is left without the runs of others, as a count of matches makes a list of them first."""
        return f"cast(length(regexp_replace({x}, r'[^{inside}]+', '')) as bigint)"

    def near(self, x: str, column: str) -> str:
        """A query's rows dealt by ``column``, so that groups and windows of it need no shuffle of what is made of them."""
        return f"select * from ({x}) dealt distribute by {column}"

    def hint(self, x: str) -> str:
        return f"/*+ {x} */ "

    def of(self, x: str, part: str) -> str:
        """``part`` of ``x`` where it is cut out beforehand, else ``x``."""
        return part

    def first_line(self, x: str, part: str) -> str:
        """The first line that holds ``part``, else an empty text: tried at starts of lines alone, so that a long line is read once."""
        return rf"regexp_extract({x}, r'(?md)^([^\n]*?{part}[^\n]*)', 1)"

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def group(self, n: int) -> str:
        """What group ``n`` matched, in the replacement of ``replace``."""
        return f"${n}"

    def like(self, x: str, pattern: str) -> str:
        return f"rlike({x}, r'{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hex(self, x: str) -> str:
        """A number from hexadecimal digits."""
        return f"cast(conv({x}, 16, 10) as bigint)"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def string(self, agg: str, order: str, sep: str) -> str:
        return f"listagg({agg}, '{sep}') within group (order by {order})"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"

    def code(self, x: str) -> str:
        return f"cast(ascii({x}) as bigint)"

    def chars(self, x: str) -> str:
        return f"filter(split({x}, ''), c -> c <> '')"


class Duck(Spark):
    name = "duckdb"

    def words(self, x: str) -> str:
        return rf"list_filter(string_split_regex({x}, '[ \t\n\r\f\v]+'), lambda w: w <> '')"

    def lines(self, x: str) -> str:
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')"

    def raw_lines(self, x: str) -> str:
        return f"list_filter(string_split({x}, chr(10)), lambda l: trim(l, ' ') <> '')"

    def grams(self, words: str, n: int) -> str:
        return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"

    def each(self, x: str) -> str:
        return f"unnest({x})"

    def once(self, x: str) -> str:
        return x

    def list(self, items: str) -> str:
        return f"[{items}]"

    def size(self, x: str) -> str:
        return f"len({x})"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def where(self, x: str, v: str, cond: str) -> str:
        return f"list_filter({x}, lambda {v}: {cond})"

    def map(self, x: str, v: str, to: str) -> str:
        return f"list_transform({x}, lambda {v}: {to})"

    def head(self, x: str, n: int) -> str:
        return f"list_slice({x}, 1, {n})"

    def total(self, x: str) -> str:
        return f"cast(coalesce(list_sum({x}), 0) as bigint)"

    def least(self, x: str) -> str:
        return f"list_min({x})"

    def range(self, a: str, b: str) -> str:
        return f"range(cast({a} as bigint), cast({b} as bigint) + 1)"

    def overlap(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, '{pattern}'))"

    def letters(self, x: str, inside: str) -> str:
        return self.count(x, f"[{inside}]")

    def near(self, x: str, column: str) -> str:
        return x

    def hint(self, x: str) -> str:
        return ""

    def of(self, x: str, part: str) -> str:
        return x

    def first_line(self, x: str, part: str) -> str:
        return self.extract(x, rf"([^\n]*{part}[^\n]*)")

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def group(self, n: int) -> str:
        return rf"\{n}"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def hex(self, x: str) -> str:
        return f"cast(('0x' || {x}) as bigint)"

    def bytes(self, x: str) -> str:
        return f"cast(strlen({x}) as bigint)"

    def string(self, agg: str, order: str, sep: str) -> str:
        return f"string_agg({agg}, '{sep}' order by {order})"

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product({a}::double[], {b}::double[])"

    def code(self, x: str) -> str:
        return f"cast(unicode({x}) as bigint)"

    def chars(self, x: str) -> str:
        return f"string_split({x}, '')"
