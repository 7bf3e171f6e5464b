"""Facts from source texts."""

import pytest

from loomgraph.sources import extract as X


def facts(lang, text, kind, path="x"):
    return [(f[4], f[5], f[8]) for f in X.facts_of(path, lang, text) if f[2] == kind]


def test_python():
    text = "import os\nfrom .a import b as c\nclass K:\n    @dec\n    def _m(self):\n        os.path.join(c())\n"
    assert [(n, t) for n, t, _ in facts("python", text, "import")] == [("os", "os"), (".a", "c")]
    assert {n for n, _, _ in facts("python", text, "symbol")} == {"K", "_m"}
    assert ("join", "os.path") in {(n, t) for n, t, _ in facts("python", text, "call")}
    assert facts("python", text, "decorator")[0][:2] == ("dec", "_m")
    assert [f[2] for f in X.facts_of("x", "python", "def (")] == ["diagnostic"]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("python", "from fastapi import FastAPI\n@app.get('/users')\ndef users(): pass", [("users", "/users", "GET")]),
        ("python", "import flask\n@app.route('/u', methods=['POST', 'PUT'])\ndef u(): pass", [("u", "/u", "POST"), ("u", "/u", "PUT")]),
        ("python", "from django.urls import path\nurlpatterns = [path('u/', views.u), path('x/', include('y'))]", [("views.u", "u/", "*")]),
        ("python", "@app.get('/users')\ndef users(): pass", []),
        ("rust", 'use axum::Router;\nlet a = Router::new().route("/u", get(list).post(add));', [("list", "/u", "GET"), ("add", "/u", "POST")]),
        ("rust", 'use actix_web::get;\n#[get("/u")]\nasync fn u() {}', [("u", "/u", "GET")]),
        ("go", 'import "github.com/gin-gonic/gin"\nfunc main() { r := gin.Default(); r.GET("/u", auth, users) }', [("users", "/u", "GET")]),
        ("typescript", "import express from 'express';\napp.get('u', auth, users);\napp.post('/x', () => 1);", [("users", "/u", "GET")]),
        ("typescript", "import {Get} from '@nestjs/common';\n@Controller('cats')\nclass C {\n @Get('all')\n all() {}\n}", [("all", "/cats/all", "GET")]),
        ("csharp", 'app.MapGet("/users", GetUsers);\n[HttpPost("x")]\npublic int Add(int a) { }', [("GetUsers", "/users", "GET"), ("Add", "/x", "POST")]),
        ("cpp", 'CROW_ROUTE(app, "/u").methods("POST"_method)(handle);', [("handle", "/u", "POST")]),
        ("cpp", 'ADD_METHOD_TO(Users::list, "/u", Get);', [("Users::list", "/u", "GET")]),
        ("cpp", 'Routes::Get(router, "/u", Routes::bind(&H::m, this));', [("H::m", "/u", "GET")]),
    ],
)
def test_routes(lang, text, want):
    assert [(n, t, d["method"]) for n, t, d in facts(lang, text, "route")] == want


def test_next_route():
    assert [(t, d["method"]) for _, t, d in facts("typescript", "export async function GET() {}", "route", "web/app/(shop)/items/[id]/route.ts")] == [("/items/:id", "GET")]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("rust", "impl<T> Repo<T> for Users<T> where T: X {}\nimpl Users {}\nimpl !Send for Y {}", [("Users", "Repo")]),
        ("typescript", "class A<T> extends B<T> implements C, D<E, F> {}", [("A", "B"), ("A", "C"), ("A", "D")]),
        ("csharp", "class S : Base, IRepo<A, B> where T : X { }", [("S", "Base"), ("S", "IRepo")]),
        ("java", "public class A extends B implements C, D { }", [("A", "B"), ("A", "C"), ("A", "D")]),
        ("kotlin", "class A(val x: Int) : B(x), C { }", [("A", "B"), ("A", "C")]),
        ("rust", "// impl A for B {}\n", []),
    ],
)
def test_type_relations(lang, text, want):
    assert [(n, t) for n, t, _ in facts(lang, text, "type_impl")] == want


def test_bindings():
    assert facts("csharp", "services.AddScoped<IUser, User>(); services.AddSingleton<Log>(); s.AddScoped<A,B,C>();", "di") == [("IUser", "User", {"lifetime": "scoped"}), ("Log", "Log", {"lifetime": "singleton"})]
    assert facts("typescript", "@Injectable({ scope: Scope.REQUEST })\nexport class A {}\n{ provide: X, useClass: Y }", "di") == [("A", "A", {"lifetime": "scoped"}), ("X", "Y", {"lifetime": "singleton"})]


def test_macros_and_decorators():
    assert facts("rust", "#[macro_export]\nmacro_rules! m { }\n#[proc_macro]\npub fn p() {}", "macro") == [("m", None, {"exported": "true"}), ("p", None, {"exported": "true"})]
    assert facts("c", "#define MAX 3", "macro")[0][0] == "MAX"
    assert facts("csharp", "[Serializable]\npublic class A {}", "decorator")[0][:2] == ("Serializable", "A")


@pytest.mark.parametrize(
    ("lang", "text", "name"),
    [("rust", "pub fn main() { go(); }", "main"), ("go", "func Run() {}", "Run"), ("typescript", "export function f() {}", "f"), ("c", "int add(int a) {\n}", "add"), ("cpp", "class A : B {\n};", "A"), ("csharp", "class A {}", "A"), ("java", "class A {}", "A"), ("kotlin", "fun f() {}", "f"), ("swift", "func f() {}", "f")],
)
def test_symbols_of_every_language(spark, lang, text, name):
    files = spark.createDataFrame([("p", lang, text), ("q", lang, None), ("r", lang, "")], "path string, language string, text string")
    assert name in {r.name for r in X.extract(files).where("fact = 'symbol'").collect()}
