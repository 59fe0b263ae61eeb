"""Questions about syntax: what guards a query, what reaches it, what a pattern is made of."""

import time

import pytest

from talonscan.operators.syntax import Tree


def line_of(code, part):
    return code[: code.index(part)].count("\n") + 1


REACHES = [
    ("export async function GET(req, { params }) {\n  const key = params.key;\n  return db.item.findUnique({ where: { key } });\n}", True),
    ("export async function GET(req, { params }) {\n  const key = params.key;\n  log(key);\n  return db.item.findMany({ take: 5 });\n}", False),
    ("async function h({ params }) {\n  const a = params.a, b = { a };\n  let c\n  c = wrap(b)\n  return conn.execute(c);\n}", True),
    ("async function h(q) {\n  const { type: kind = 'x', ...rest } = q.searchParams;\n  return conn.query(build(kind));\n}", True),
    ("async function h(q) {\n  const { type: kind } = q.searchParams;\n  return conn.query(build(type));\n}", False),
    ("export const h = async () => db.item.findMany();", False),
    ("// params\nconst s = 'params'; conn.query(`select ${1}`);", False),
    ("const x = f(params)\nconn.query(`select ${x}`)", True),
    ("const x = f(params)\nconn.query<Row[]>(x)", True),
    ("const re = /[`'\"(]/.test(params.x) ? 1 : 2;\nconn.query('a', re)", True),
]


@pytest.mark.parametrize("code, wanted", REACHES)
def test_parameter_reaches_sink(code, wanted):
    assert Tree(code).parameter_reaches_sink() is wanted


FINDS = [
    ("db.token.findUnique({ where: { id: params.id, projectId: workspace.id } })", True),
    ("db.token.findUnique({ where: { id: params.id }, select: { userId: true } })", False),
    ("db.token.findUnique({ where: { id: params.id, workspaceId: params.workspaceId } })", False),
    ("db.team.findFirst({ where: { id: a.teamId, members: { some: { userId: a.userId } } } })", True),
    ("db.team.findFirst({ where: { id: a.teamId, members: { some: { userId: req.body.userId } } } })", False),
    ("db.team.findFirst({ where: { id, userId } })", True),
    ("db.team\n    .findFirst({ where: { id: 1 } })", False),
]


@pytest.mark.parametrize("query, wanted", FINDS)
def test_owner_in_a_query(query, wanted):
    code = f"export async function GET({{ params }}) {{\n  const t = await {query};\n  return t;\n}}"
    assert Tree(code).find_is_guarded(2) is wanted


def test_owner_compared_or_checked():
    after = "async function h(ctx, input) {\n  const t = await db.t.findUnique({ where: { id: input.tId } });\n  if (t.userId !== ctx.user.id) throw 1;\n  await db.t.delete({ where: { id: input.tId } });\n}"
    assert Tree(after).find_is_guarded(2) and Tree(after).change_is_guarded(4)
    other = after.replace("  if (t.userId !== ctx.user.id) throw 1;\n", "") + "\nfunction k(t, ctx) {\n  return t.userId !== ctx.user.id;\n}"
    assert not Tree(other).find_is_guarded(2) and not Tree(other).change_is_guarded(3)
    check = "const h = async (ctx, input) => {\n  await assertTeamAdmin(ctx.user.id, input.forId);\n  return db.t.update({ where: { id: input.forId } });\n};"
    assert Tree(check).change_is_guarded(3)
    assert not Tree(check.replace("assertTeamAdmin", "formatTeam")).change_is_guarded(3)
    assert not Tree(check.replace("input.forId);", "input.other);")).change_is_guarded(3)
    assert not Tree(check).find_is_guarded(3) and not Tree("x").change_is_guarded(1)


CONSTANT = [
    ("const BOTS = ['a', 'b'];\nconst f = (ua) => BOTS.some((bot) => new RegExp(bot, 'i').test(ua));", True),
    ("function f() {\n  const p = '^[a-z]+$';\n  return new RegExp(p);\n}", True),
    ("['a', `b`].forEach(function (p) { const re = new RegExp(p); });", True),
    ("function f(c) {\n  return new RegExp(c.source, c.flags);\n}", True),
    ("import { LIST } from './l';\nexport const f = (ua) => LIST.some((b) => new RegExp(b).test(ua));", True),
    ("new RegExp('x' + y)", False),
    ("function f(req) {\n  const p = req.query.p;\n  return new RegExp(p);\n}", False),
    ("export function f(p) {\n  return new RegExp(p);\n}", False),
    ("const l = [req.a, 'b'];\nl.some((p) => new RegExp(p).test(x));", False),
    ("export const f = (l) => l.some((p) => new RegExp(p).test(x));", False),
    ("const re = new RegExp(`a${b}`);", False),
]


@pytest.mark.parametrize("code, wanted", CONSTANT)
def test_regexp_is_constant(code, wanted):
    assert Tree(code).regexp_is_constant(line_of(code, "new RegExp")) is wanted


def test_bare_sql():
    code = "const q = `select ${x}`;\ndb.query(q, [1]);\ndb.query('a');\nquery(q);\ndb\n  .raw(q);"
    assert Tree(code).bare_sql() == [(2, "q"), (6, "q")]


@pytest.mark.parametrize("text", ["", "(" * 5000, ")" * 5000, "`${" * 3000, "'" * 9999, "/" * 9999, "a.b(" * 3000, "{[(" * 2000 + "}" * 2000, "\\" * 5000, "=>" * 5000, "const " * 5000, "x=>" * 3000, "é`😀${a}`"])
def test_any_text_is_read(text):
    began = time.time()
    tree = Tree(text)
    tree.parameter_reaches_sink(), tree.find_is_guarded(1), tree.change_is_guarded(1), tree.regexp_is_constant(1), tree.bare_sql()
    assert time.time() - began < 2


def test_time_grows_in_proportion():
    def took(n):
        code = "".join(f"export async function f{k}(req, {{ params }}) {{\n  const v{k} = params.a{k};\n  await db.t.update({{ where: {{ id: v{k} }} }});\n}}\n" for k in range(n))
        began = time.process_time()
        tree = Tree(code)
        tree.parameter_reaches_sink(), tree.change_is_guarded(4 * n - 1), tree.regexp_is_constant(1)
        return time.process_time() - began

    took(100)
    assert took(4000) < 14 * took(500) + 0.5
