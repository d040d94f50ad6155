"""A stored closure brought up to date equals one computed from nothing."""

import random

import pytest

from corpusspark.operators import closure

SCHEMA = "path string, content string"


def workspace(rng, n=70):
    files = {}
    for i in range(n):
        kind = rng.choice(["vue", "api", "controller", "service"])
        other = [rng.randrange(n) for _ in range(3)]
        if kind == "vue":
            body = "".join(f"import X{o} from './V{o}'\n" for o in other[:2]) + f"this.$api.m{other[2]}.call{other[2]}()\nconst u = '/base{other[0]}/leaf{other[0]}'\n"
            files[f"repos/a/src/V{i}.vue"] = body
        elif kind == "api":
            body = "".join(f"export const call{o} = () => {{\n  return request({{ url: '/base{o}/leaf{o}' }})\n}}\n" for o in (i, *other[:2]))
            files[f"repos/a/src/api/m{i}.js"] = body
        elif kind == "controller":
            body = f"import x.Thing{other[0]}Service;\n@RequestMapping(\"base{i}\")\npublic class C{i}Controller {{\n  private Thing{other[1]}Service s;\n  @PostMapping(\"/leaf{i}\")\n}}\n"
            files[f"repos/b/C{i}Controller.java"] = body
        else:
            files[f"repos/b/Thing{i}Service.java"] = f"public interface Thing{i}Service {{}}\n"
            files[f"repos/b/Thing{i}ServiceImpl.java"] = f"public class Thing{i}ServiceImpl implements Thing{i}Service extends Thing{other[0]}Service {{}}\n"
    return files


def table(spark, files):
    return spark.createDataFrame(list(files.items()), SCHEMA)


def seeds(spark, files, rng):
    names = sorted(files)
    rows = [(f"B{b}", rng.choice(names), no) for b in range(6) for no in range(rng.randint(1, 2))] + [("gone", "no/such/file", 0)]
    return spark.createDataFrame(rows, "batch_id string, path string, seed_no int")


def nodes(c):
    return sorted(map(tuple, c.nodes.select("batch_id", "path", "seq", "level").collect()))


def edges(c):
    return sorted(map(tuple, c.edges.select("batch_id", "src", "dst", "kind", "symbol").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_recomputation(spark, seed, monkeypatch):
    rng = random.Random(seed)
    files = workspace(rng)
    start = seeds(spark, files, rng)
    index = closure.build_index(table(spark, files))
    scoped = {"scope": spark.createDataFrame([(f"B{b}", r) for b in range(6) for r in (("repos/a", "repos/b") if b else ("repos/a",))], "batch_id string, repo_path string"),
              "repos": spark.createDataFrame([("a", "repos/a"), ("b", "repos/b")], "name string, path string")}
    options = scoped if seed == 2 else {}
    kept = closure.closure(index, start, **options)
    assert len(nodes(kept)) > 12
    spare = workspace(random.Random(99))
    derived, derive = [], closure._derive
    monkeypatch.setattr(closure, "_derive", lambda rules, visited, *rest: derived.append({r[0] for r in visited.select("batch_id").distinct().collect()}) or derive(rules, visited, *rest))
    for _ in range(2):
        after = dict(files)
        for path in rng.sample(sorted(files), 3):
            change = rng.choice(["drop", "empty", "swap"])
            if change == "drop":
                del after[path]
            else:
                after[path] = "" if change == "empty" else files[rng.choice(sorted(files))]
        added = rng.choice(sorted(spare))
        after[added] = spare[added]
        changed = [(p,) for p in files.keys() | after.keys() if files.get(p) != after.get(p)]
        fresh = closure.refreshed_index(index, spark.createDataFrame(changed, "path string"), table(spark, after))
        kept = closure.updated_closure(kept, fresh, start, **options)
        touched = derived.pop()
        whole = closure.closure(closure.build_index(table(spark, after)), start, **options)
        derived.pop()
        assert nodes(kept) == nodes(whole) and edges(kept) == edges(whole)
        assert touched <= {r[0] for r in start.select("batch_id").collect()}
        files, index = after, fresh


def test_unchanged_files_touch_no_batch(spark, monkeypatch):
    rng = random.Random(5)
    files = workspace(rng, 30)
    start = seeds(spark, files, rng)
    index = closure.build_index(table(spark, files))
    kept = closure.closure(index, start)
    reached = {r.path for r in kept.nodes.collect()}
    outside = next(p for p in sorted(files) if p not in reached and p.endswith(".vue"))
    after = {**files, outside: files[outside] + "// a remark\n"}
    fresh = closure.refreshed_index(index, spark.createDataFrame([(outside,)], "path string"), table(spark, after))
    seen = []
    monkeypatch.setattr(closure, "_derive", lambda rules, visited, *rest, d=closure._derive: seen.append(visited.count()) or d(rules, visited, *rest))
    again = closure.updated_closure(kept, fresh, start)
    assert seen == [0] and nodes(again) == nodes(kept) and edges(again) == edges(kept)


def test_other_seeds_and_scopes(spark):
    rng = random.Random(8)
    files = workspace(rng, 40)
    index = closure.build_index(table(spark, files))
    repos = spark.createDataFrame([("a", "repos/a"), ("b", "repos/b")], "name string, path string")
    first, second = seeds(spark, files, rng), seeds(spark, files, rng)

    def scope(*pairs):
        return spark.createDataFrame(list(pairs), "batch_id string, repo_path string")

    wide = scope(*[(f"B{b}", r) for b in range(6) for r in ("repos/a", "repos/b")])
    narrow = scope(*[(f"B{b}", "repos/a") for b in range(3)], *[(f"B{b}", r) for b in range(3, 6) for r in ("repos/a", "repos/b")])
    kept = closure.updated_closure(closure.closure(index, first, scope=wide, repos=repos), index, second, scope=narrow, repos=repos)
    whole = closure.closure(index, second, scope=narrow, repos=repos)
    assert nodes(kept) == nodes(whole) and edges(kept) == edges(whole)


def test_contract_names_in_a_very_long_stem(spark):
    stem = "Alpha" * 200 + "OrderServiceImpl"
    files = {f"r/{stem}.java": "public class X {}\n", "r/User.java": "import y.OrderService;\nimport z.AlphaOrderService;\npublic class User extends BetaService {}\n"}
    found = closure.reference_edges(closure.build_index(table(spark, files))).collect()
    assert {(r.symbol, r.kind) for r in found} == {("OrderService", "java_interface_or_contract_implementation"), ("AlphaOrderService", "java_interface_or_contract_implementation")}
