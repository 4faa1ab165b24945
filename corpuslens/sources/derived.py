"""A source-code corpus derived from the ``orders`` table, for checks and benches.

Every order becomes one file: its customer decides the repository, its key the file.  The file texts
are the short snippets below, eight for each of fourteen kinds of project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 8
CUSTOMERS_PER_REPOSITORY = 10

# (path, text); "{k}" in a path is the order key.
SNIPPETS = [
    # Flask service
    ("app/m{k}/routes.py", "from flask import Flask, render_template\nimport sqlite3\napp = Flask(__name__)\n\n@app.route('/')\ndef index():\n    return render_template('index.html')\n"),
    ("app/models/item{k}.py", "from flask_sqlalchemy import SQLAlchemy\ndb = SQLAlchemy(app)\n\nclass Item(db.Model):\n    id = db.Column(db.Integer, primary_key=True)\n    owner = db.relationship('Owner')\n"),
    ("services/s{k}/requirements.txt", "# runtime\nflask==2.0.1\nflask-sqlalchemy==2.5\npsycopg2-binary==2.9\npytest==7.0\n"),
    ("tests/test_routes{k}.py", "import pytest\nfrom app import routes\n\ndef test_index(client):\n    assert client.get('/').status_code == 200\n"),
    ("deploy/d{k}/Dockerfile", "FROM python:3.11\nWORKDIR /srv\nCOPY . /srv\nRUN pip install -r requirements.txt\nEXPOSE 5000\n"),
    ("deploy/d{k}/docker-compose.yml", "version: '3'\nservices:\n  db:\n    image: postgres\n    environment:\n      POSTGRES_PASSWORD: secret\n      POSTGRES_DB: shop\n"),
    ("app/views/page{k}.html", "{% extends 'base.html' %}\n{% block body %}<div class=\"row btn\">{{ item.name }}</div>{% endblock %}\n"),
    ("app/settings{k}.py", "SQLALCHEMY_DATABASE_URI = 'postgresql://shop:pw@db/shop'\nREDIS_URL = 'redis://cache:6379'\n"),
    # Django site
    ("site{k}/settings.py", "INSTALLED_APPS = ['django.contrib.admin']\nMIDDLEWARE = []\nDATABASES = {'default': {'ENGINE': 'django.db.backends.postgresql'}}\n"),
    ("shop/m{k}/models.py", "from django.db import models\n\nclass Order(models.Model):\n    total = models.IntegerField()\n    note = models.TextField()\n"),
    ("shop/m{k}/views.py", "from django.shortcuts import render\nfrom django.http import HttpResponse\n\ndef show(request):\n    return render(request, 'shop/show.html')\n"),
    ("shop/m{k}/urls.py", "from django.urls import path\nurlpatterns = [path('', views.show)]\n"),
    ("shop/templates/p{k}.html", "{% load static %}\n<h1>{{ title }}</h1>\n{% include 'menu.html' %}\n"),
    ("reqs/r{k}/requirements.txt", "django==4.2\ncelery==5.2\npsycopg2==2.9\npytest-django==4.5\n"),
    ("tests/unit/test_models{k}.py", "from unittest import TestCase\n\nclass OrderTest(TestCase):\n    def test_total(self):\n        self.assertEqual(1, 1)\n"),
    (".github/workflows/ci{k}.yml", "name: ci\non: push\njobs:\n  test:\n    steps:\n      - uses: actions/checkout\n      - run: pip install -r requirements.txt\n"),
    # Express service
    ("src/m{k}/app.js", "const express = require('express')\nconst app = express()\napp.use(express.json())\napp.get('/users', list)\napp.post('/users', add)\napp.listen(3000)\n"),
    ("src/models/user{k}.js", "const mongoose = require('mongoose')\nconst schema = new mongoose.Schema({name: String})\nmodule.exports = mongoose.model('User', schema)\nmongoose.connect('mongodb://localhost/shop')\n"),
    ("src/controllers/userController{k}.js", "exports.list = async (req, res) => { res.json(await User.find({})) }\n"),
    ("pkg{k}/package.json", "{\"name\": \"api\", \"dependencies\": {\"express\": \"4\", \"mongoose\": \"6\"}, \"devDependencies\": {\"mocha\": \"9\", \"chai\": \"4\"}}"),
    ("test/user{k}.test.js", "const { expect } = require('chai')\ndescribe('users', function () {\n  it('lists', function () {\n    expect([]).to.be.an('array')\n  })\n})\n"),
    ("ops/o{k}/Dockerfile", "FROM node:18\nWORKDIR /app\nRUN npm ci\nCMD [\"node\", \"app.js\"]\n"),
    ("ops/o{k}/docker-compose.yml", "services:\n  mongo:\n    image: mongo\n    environment:\n      MONGO_INITDB_DATABASE: shop\n"),
    ("docs/api{k}.md", "# API\n"),
    # React application
    ("src/components/Card{k}.jsx", "import React, { useState, useEffect } from 'react'\nexport default function Card() {\n  const [n, setN] = useState(0)\n  useEffect(() => setN(1))\n  return <Row />\n}\n"),
    ("src/store/s{k}/store.js", "import { createStore, combineReducers } from 'redux'\nexport default createStore(combineReducers({}))\n"),
    ("src/reducers/r{k}.js", "export default (state, action) => state\n"),
    ("src/a{k}/App.jsx", "import React from 'react'\nimport { Provider } from 'react-redux'\nclass App extends React.Component { render() { return <Main /> } }\n"),
    ("web{k}/package.json", "{\"dependencies\": {\"react\": \"18\", \"react-dom\": \"18\", \"redux\": \"4\", \"@mui/material\": \"5\"}, \"devDependencies\": {\"jest\": \"29\", \"webpack\": \"5\"}}"),
    ("src/__tests__/Card{k}.test.js", "import { render, screen } from '@testing-library/react'\ntest('shows', () => {\n  render(<Card />)\n  expect(screen.getByText('x')).toBeTruthy()\n})\n"),
    ("config{k}/webpack.config.js", "const webpack = require('webpack')\nmodule.exports = { entry: './src', output: {}, module: { rules: [] } }\n"),
    ("styles/s{k}.module.scss", ".card { color: red }\n"),
    # Vue application
    ("src/views/Page{k}.vue", "<template>\n  <v-btn v-if=\"ok\" v-on:click=\"go\">go</v-btn>\n</template>\n<script>\nimport Vue from 'vue'\n</script>\n"),
    ("src/store/index{k}.ts", "import { createStore } from 'vuex'\nexport default createStore({ state: {}, mutations: {} })\n"),
    ("src/m{k}/main.ts", "import { createApp } from 'vue'\nimport App from './App.vue'\ncreateApp(App).mount('#app')\n"),
    ("ui{k}/package.json", "{\"dependencies\": {\"vue\": \"3\", \"vuex\": \"4\", \"vuetify\": \"3\"}, \"devDependencies\": {\"vitest\": \"1\", \"vite\": \"5\"}}"),
    ("conf{k}/vite.config.ts", "export default { plugins: [] }\n"),
    ("conf{k}/tsconfig.json", "{\"compilerOptions\": {\"target\": \"es2020\", \"module\": \"esnext\", \"outDir\": \"out\"}}"),
    ("src/features/f{k}/list.spec.ts", "import { test, expect } from 'vitest'\ntest('list', () => { expect(1).toBe(1) })\n"),
    ("src/viewmodels/V{k}ViewModel.ts", "export class ListViewModel extends ViewModel {}\n"),
    # Angular application
    ("src/m{k}/app.module.ts", "import { NgModule } from '@angular/core'\n@NgModule({ imports: [] })\nexport class AppModule {}\n"),
    ("src/m{k}/app.component.ts", "import { Component } from '@angular/core'\n@Component({ selector: 'app' })\nexport class AppComponent {}\n"),
    ("src/services/user{k}.service.ts", "import { Injectable } from '@angular/core'\n@Injectable({ providedIn: 'root' })\nexport class UserService {}\n"),
    ("ng{k}/angular.json", "{\"version\": 1, \"projects\": {}}"),
    ("ng{k}/package.json", "{\"dependencies\": {\"@angular/core\": \"17\", \"rxjs\": \"7\", \"@ngrx/store\": \"17\"}, \"devDependencies\": {\"jasmine\": \"5\", \"karma\": \"6\"}}"),
    ("src/m{k}/app.component.html", "<div [(ngModel)]=\"name\" class=\"flex p-4 m-2 text-lg bg-red\">{{ name }}</div>\n"),
    ("src/m{k}/user.spec.ts", "describe('user', () => { it('works', () => { expect(true).toBe(true) }) })\n"),
    ("conf{k}/karma.conf.js", "module.exports = function (config) {}\n"),
    # Spring service
    ("src/main/java/shop/controller/C{k}Controller.java", "import org.springframework.web.bind.annotation.*;\n@RestController\npublic class OrderController {\n  @Autowired OrderService service;\n  @GetMapping(\"/orders\") public List<Order> all() { return service.all(); }\n}\n"),
    ("src/main/java/shop/service/S{k}Service.java", "import org.springframework.stereotype.Service;\n@Service\npublic class OrderService {}\n"),
    ("src/main/java/shop/repository/R{k}Repository.java", "@Repository\npublic interface OrderRepository extends JpaRepository<Order, Long> {}\n"),
    ("src/main/java/shop/entity/E{k}Entity.java", "import javax.persistence.Entity;\n@Entity\n@Table(name = \"orders\")\npublic class OrderEntity { @Column String name; }\n"),
    ("src/test/java/shop/T{k}Test.java", "import org.junit.Test;\npublic class OrderTest {\n  @Test public void testTotal() { Assert.assertEquals(1, 1); }\n}\n"),
    ("mod{k}/pom.xml", "<project xmlns=\"http://maven.apache.org/POM/4.0.0\">\n<groupId>shop</groupId>\n<artifactId>orders</artifactId>\n</project>\n"),
    ("src/main/resources/p{k}/application.properties", "spring.datasource.url=jdbc:mysql://db/shop\n"),
    ("ci{k}/Jenkinsfile.yml", "stages:\n  - build\nsteps:\n  - run: mvn clean install\n"),
    # Rails site
    ("app/models/order{k}.rb", "class Order < ApplicationRecord\n  belongs_to :customer\n  has_many :lines\nend\n"),
    ("app/controllers/orders{k}_controller.rb", "class OrdersController < ApplicationController\n  def index\n    render json: Order.all\n  end\nend\n"),
    ("app/views/orders/o{k}.html", "<div class=\"container\"><a class=\"btn btn-primary\">new</a></div>\n"),
    ("cfg{k}/Gemfile", "source 'https://rubygems.org'\ngem 'rails'\ngem 'pg'\ngem 'rspec-rails'\n"),
    ("spec/models/order{k}_spec.rb", "require 'rspec'\nRSpec.describe Order do\n  it 'adds' do\n    expect(1).to eq(1)\n  end\nend\n"),
    ("config/c{k}/routes.rb", "Rails.application.routes.draw do\n  resources :orders\nend\n"),
    ("tasks{k}/Rakefile", "task :default\n"),
    ("db/d{k}/schema.rb", "ActiveRecord::Schema.define {}\n"),
    # Laravel site
    ("app/Http/Controllers/C{k}Controller.php", "<?php\nnamespace App\\Http\\Controllers;\nuse Illuminate\\Http\\Request;\nclass OrderController extends Controller {}\n"),
    ("app/Models/M{k}.php", "<?php\nnamespace App\\Models;\nuse Illuminate\\Database\\Eloquent\\Model;\nclass Order extends Model {}\n"),
    ("resources/views/v{k}.php", "<h1 class=\"row\">orders</h1>\n"),
    ("pkg{k}/composer.json", "{\"require\": {\"laravel/framework\": \"10\"}, \"require-dev\": {\"phpunit/phpunit\": \"10\"}}"),
    ("routes/r{k}/web.php", "<?php\nuse Illuminate\\Support\\Facades\\Route;\nRoute::get('/', fn () => view('home'));\n"),
    ("tests/Feature/O{k}Test.php", "<?php\nuse PHPUnit\\Framework\\TestCase;\nclass OrderTest extends TestCase {\n  public function testTotal() { $this->assertTrue(true); }\n}\n"),
    ("config/db{k}.php", "<?php return ['host' => env('DB_HOST'), 'url' => 'mysql://root:pw@db/shop'];\n"),
    ("bin{k}/run.sh", "composer install\nphp artisan migrate\n"),
    # ASP.NET site
    ("Controllers/C{k}Controller.cs", "using Microsoft.AspNetCore.Mvc;\npublic class OrderController : Controller {\n  public IActionResult Index() => View();\n}\n"),
    ("Models/M{k}.cs", "using Microsoft.EntityFrameworkCore;\npublic class ShopContext : DbContext {\n  public DbSet<Order> Orders { get; set; }\n  protected override void OnModelCreating(ModelBuilder b) {}\n}\n"),
    ("Views/V{k}.html", "<div class=\"col-6\">orders</div>\n"),
    ("src{k}/Shop.csproj", "<Project Sdk=\"Microsoft.NET.Sdk.Web\">\n<PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup>\n<PackageReference Include=\"Npgsql\" />\n</Project>\n"),
    ("src{k}/Program.cs", "var builder = WebApplication.CreateBuilder(args);\nvar app = builder.Build();\napp.Run();\n"),
    ("Tests/T{k}Tests.cs", "public class OrderTests {\n  [Fact]\n  public void Adds() { Assert.Equal(1, 1); }\n}\n"),
    ("src{k}/appsettings.json", "{\"ConnectionStrings\": {\"Default\": \"sqlserver://db/shop\"}}"),
    ("pipe{k}/azure-pipelines.yml", "steps:\n- script: az storage upload\n  env:\n    AZURE_KEY: x\n"),
    # Go service
    ("cmd/c{k}/main.go", "package main\nimport (\n  \"github.com/gin-gonic/gin\"\n)\nfunc main() { r := gin.Default(); r.GET(\"/\", home); r.Run() }\n"),
    ("internal/store/s{k}.go", "package store\nimport \"gorm.io/gorm\"\nfunc Open() { db := gorm.Open(nil) }\n"),
    ("mod{k}/go.mod", "module shop\nrequire (\n  github.com/gin-gonic/gin v1.9.0\n)\n"),
    ("internal/store/s{k}_test.go", "package store\nfunc TestOpen(t *testing.T) {}\n"),
    ("tools{k}/Makefile", "test:\n\tgo test ./...\n"),
    ("scripts/b{k}.sh", "go build ./cmd\nmake all\n"),
    ("deploy/k8s/d{k}.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: shop\nspec:\n  replicas: 2\n"),
    ("internal/graph/q{k}.go", "package graph\nconst schema = `type Query { orders: [Order] }`\n"),
    # Data science
    ("train/t{k}.py", "import torch\nimport torch.nn as nn\nclass Net(nn.Module):\n    pass\n"),
    ("notebooks/n{k}.py", "import pandas as pd\nimport numpy as np\nframe = pd.read_csv('x.csv')\nvalues = np.array([1])\n"),
    ("train/f{k}.py", "import tensorflow as tf\nmodel = tf.keras.Sequential()\n"),
    ("env{k}/environment.yml", "dependencies:\n  - pandas\n"),
    ("pkg{k}/setup.py", "from setuptools import setup\nsetup(name='ml', packages=['ml'], install_requires=['torch'])\n"),
    ("pkg{k}/pyproject.toml", "[tool.poetry]\nname = 'ml'\n[tool.poetry.dev-dependencies]\npytest = '7'\nhypothesis = '6'\n"),
    ("tests/test_net{k}.py", "import unittest\nimport sqlite3\nclass NetTest(unittest.TestCase):\n    def test_open(self):\n        self.assertTrue(sqlite3.connect(':memory:'))\n"),
    ("README{k}.md", "# Models\n"),
    # Infrastructure
    ("services/orders{k}/Dockerfile", "FROM golang:1.21\nWORKDIR /go\nRUN go build\nENTRYPOINT [\"/go/app\"]\n"),
    ("charts/c{k}/Chart.yaml", "apiVersion: v2\nname: shop\n"),
    ("charts/c{k}/values.yaml", "replicas: 1\n"),
    ("terraform/t{k}/main.tf", "resource \"aws_s3_bucket\" \"b\" {}\n"),
    ("k8s/k{k}/service.yaml", "apiVersion: v1\nkind: Service\nmetadata:\n  name: shop\nspec:\n  ports: []\n"),
    ("api-gateway/g{k}.yml", "routes:\n  - uri: kafka://events\n    redis: redis://cache\n    host: REDIS_HOST\n"),
    ("lib/l{k}/cdk.json", "{\"app\": \"node bin/cdk.js\"}"),
    (".gitlab-ci{k}.yml", "stages:\n  - test\nbuild:\n  script: kubectl apply -f k8s\n"),
    # Split frontend and backend
    ("backend/app/m{k}/main.py", "from fastapi import FastAPI\nimport sqlite3\napp = FastAPI()\n\n@app.get('/')\ndef root():\n    return sqlite3.connect('x.db')\n"),
    ("backend/app/models/t{k}.py", "from sqlalchemy import Column, Integer, create_engine\nengine = create_engine('sqlite:///shop.db')\nid = Column(Integer)\n"),
    ("backend/r{k}/requirements.txt", "fastapi==0.100\nsqlalchemy==2.0\nuvicorn==0.23\n"),
    ("frontend/p{k}/package.json", "{\"dependencies\": {\"react\": \"18\", \"react-dom\": \"18\"}, \"scripts\": {\"start\": \"npm run dev\"}}"),
    ("frontend/src/a{k}/App.js", "import React, { useState } from 'react'\nexport default () => <List />\n"),
    ("frontend/src/components/L{k}.js", "import React, { useEffect } from 'react'\nexport const List = () => { useEffect(() => fetch('/users')) }\n"),
    ("ops/o{k}/docker-compose.yml", "services:\n  api:\n    build: .\n    command: docker run\n"),
    ("backend/api/v1/users{k}.py", "from fastapi import APIRouter\nrouter = APIRouter()\n\n@app.post('/users')\ndef add():\n    pass\n"),
]
PROJECT_KINDS = len(SNIPPETS) // SLOTS


def spread(rows: DataFrame) -> DataFrame:
    """Use every core even when the input is a single small file: moves narrow rows, no text."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def derived_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo_id, path, size, content)`` with one row per order."""
    snippets = F.broadcast(
        spark.createDataFrame(
            [(i, path, content) for i, (path, content) in enumerate(SNIPPETS)],
            "snippet int, pattern string, content string",
        )
    )
    repo_no = F.floor(F.col("o_custkey") / CUSTOMERS_PER_REPOSITORY)
    snippet = (repo_no % PROJECT_KINDS) * SLOTS + F.col("o_orderkey") % SLOTS
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", repo_no.alias("repo_no"), snippet.cast("int").alias("snippet")
    )
    return (
        spread(keys)
        .join(snippets, "snippet")
        .select(
            F.concat(F.lit("repo_"), F.col("repo_no").cast("string")).alias("repo_id"),
            F.replace("pattern", F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("path"),
            F.octet_length("content").cast("bigint").alias("size"),
            "content",
        )
    )


def derived_corpus_sql() -> str:
    """The same corpus as a DuckDB common table expression body, plus its ``snippet`` number."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({i}, {quote(p)}, {quote(c)})" for i, (p, c) in enumerate(SNIPPETS))
    return f"""snippets(snippet, pattern, content) AS (VALUES {values}),
files AS (
  SELECT 'repo_' || CAST(o_custkey // {CUSTOMERS_PER_REPOSITORY} AS VARCHAR) AS repo_id,
         replace(pattern, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS path,
         CAST(strlen(content) AS BIGINT) AS size, content, snippet
  FROM orders JOIN snippets
    ON snippet = ((o_custkey // {CUSTOMERS_PER_REPOSITORY}) % {PROJECT_KINDS}) * {SLOTS} + o_orderkey % {SLOTS}
)"""
