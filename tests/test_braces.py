from tessera.parse.braces import parse_csharp, parse_script, parse_vue

SCRIPT = """
import React, { useState as us } from "./react";
export * from "./all";
/** Keeps items. */
export class Store {
  constructor(private db: Db) {}
  async load(id: string): Promise<T> {
    // fetch("/no")
    return this.find(await fetch(`/api/items/${item.id}`, { method: "POST" }));
  }
  find(x) { return axios.get("/api/x"); }
}
export const Card = ({ a }) => {
  return <Button a={a}>{helper(a)}</Button>;
};
function helper(q) { return process.env.KEY ?? "d"; }
router.get("/items/:id", show);
app.use("/v1", router);
const routes = [{ path: "/home", component: Home }, { path: "/old", redirect: "/home" }];
"""


def said(facts):
    return {(f["fact"], f["src"], f["name"], f["value"], f["extra"]) for f in facts}


def test_script():
    symbols, facts, bad = parse_script("w:a.ts", SCRIPT)
    assert not bad and [(s["qualname"], s["display_kind"], s["start_line"], s["end_line"]) for s in symbols] == [("Store", "class", 5, 12), ("Store.constructor", "method", 6, 6), ("Store.load", "method", 7, 10), ("Store.find", "method", 11, 11), ("Card", "component", 13, 15), ("helper", "function", 16, 16)]
    assert symbols[0]["doc"] == "Keeps items."
    got = said(facts)
    assert {
        ("import", "", "./react", "us", "useState"), ("reexport", "", "./all", "*", "*"), ("env", "helper", "KEY", "d", None), ("client", "Store.load", "POST", "/api/items/{id}", None), ("client", "Store.find", "GET", "/api/x", None),
        ("route", "", "GET", "/items/:id", "router|show"), ("mount", "", "router", "/v1", "app"), ("client-route", "", "/home", "Home", None), ("client-route", "", "/old", None, "/home"), ("render", "Card", "Button", None, None),
        ("call", "Store.load", "find", "this.find", "this"), ("call", "Card", "helper", "helper", "name"),
    } <= got
    assert not [f for f in got if f[2] == "/no" or f[0] == "call" and f[2] == "load"]


def test_test_names():
    text = "describe('top', () => {\n  it('works', async () => {\n    expect(run()).toBe(1);\n  });\n});\n"
    symbols, facts, _ = parse_script("t", text, True)
    assert [(s["qualname"], s["kind"]) for s in symbols] == [("top", "test"), ("top > works", "test")]
    assert ("call", "top > works", "run", "run", "name") in said(facts)


def test_vue():
    text = '<template>\n  <my-card /><a href="/api/file">x</a>\n</template>\n<script setup>\nfunction go() { return fetch("/api/go"); }\n</script>\n'
    symbols, facts, _ = parse_vue("v", text)
    assert [(s["name"], s["start_line"]) for s in symbols] == [("go", 5)]
    assert {("render", "", "MyCard", None, None), ("client", "", "GET", "/api/file", None), ("client", "go", "GET", "/api/go", None)} <= said(facts)


def test_csharp():
    text = 'using System.Linq;\nnamespace App.Web;\n[Route("api/[controller]")]\npublic class ItemsController : Base\n{\n    private readonly IStore _store;\n    [HttpGet("{id:int}")]\n    public async Task<Item> Get(int id)\n    {\n        return await _store.Load(id, Environment.GetEnvironmentVariable("DSN"));\n    }\n    public int Twice(int x) => x * 2;\n}\npublic class Tests { [Fact]\n    public void Works() { new ItemsController().Get(1); } }\napp.MapPost("/go", Run);\n'
    symbols, facts, _ = parse_csharp("w:a.cs", text)
    assert [(s["qualname"], s["kind"]) for s in symbols] == [("ItemsController", "symbol"), ("ItemsController.Get", "symbol"), ("ItemsController.Twice", "symbol"), ("Tests", "symbol"), ("Tests.Works", "test")]
    got = said(facts)
    assert {("route", "ItemsController.Get", "GET", "/api/items/{id:int}", None), ("route", "", "POST", "/go", None), ("field", "ItemsController", "_store", "IStore", None), ("env", "ItemsController.Get", "DSN", None, None), ("using", "", "System.Linq", None, None), ("construct", "Tests.Works", "ItemsController", None, None)} <= got


def test_broken_texts_are_read_as_far_as_they_go():
    for parse in (parse_script, parse_vue, parse_csharp):
        for text in ("", "class {", "}}}(((", "function a() {", "`", "/*", "import {"):
            parse("x", text, True)
