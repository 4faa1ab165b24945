"""Framework rules: literals looked up in paths and contents, and the proofs that confirm them."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

PATTERNS = {
    "Django": [
        "django", "settings.py", "wsgi.py", "asgi.py", "urls.py", "manage.py", "django.contrib",
        "from django", "import django",
    ],
    "Flask": ["flask", "Flask(__name__", "app = Flask", "from flask import", "import flask"],
    "FastAPI": ["fastapi", "from fastapi import", "FastAPI(", "app = FastAPI", "import fastapi"],
    "Pyramid": ["pyramid", "from pyramid", "import pyramid", "config.add_route", "config.add_view"],
    "Tornado": [
        "tornado", "tornado.web", "tornado.ioloop", "class MainHandler(tornado.web.RequestHandler)",
        "from tornado import",
    ],
    "SQLAlchemy": [
        "sqlalchemy", "from sqlalchemy import", "import sqlalchemy", "Base = declarative_base()",
        "Column(", "relationship(", "db.Column", "db.relationship", "flask_sqlalchemy",
    ],
    "Celery": [
        "celery", "from celery import", "import celery", "@app.task", "@shared_task",
        "celery.contrib",
    ],
    "React": [
        "react", "import React", "from 'react'", 'from "react"', "React.Component", "useState",
        "useEffect", "jsx", "tsx",
    ],
    "Vue.js": ["vue", "import Vue", "new Vue", "createApp", "<template>", "vue-router", ".vue"],
    "Angular": [
        "angular", "@angular/core", "Component({", "NgModule", "app.module.ts", "angular.module",
        "@Component", "@Injectable",
    ],
    "Next.js": [
        "next", "import next", "next.config.js", "getStaticProps", "getServerSideProps", "pages/",
        "_app.js", "_document.js",
    ],
    "Express": [
        "express", "app.get(", "app.post(", "app.use(", "express.Router()", "app.listen(",
        "import express", "require('express')", 'require("express")',
    ],
    "NestJS": [
        "nestjs", "@nestjs", "@Controller", "@Injectable", "nest-cli.json", "@Module", "@Resolver",
    ],
    "Svelte": [
        "svelte", ".svelte", "onMount", "onDestroy", "svelte.config.js", "import { onMount }",
    ],
    "jQuery": [
        "jquery", "$.", "jQuery", "$(document).ready", "$.ajax", "$('#", "require('jquery')",
    ],
    "Spring": [
        "spring", "springframework", "@Service", "@Controller", "@RestController", "@Repository",
        "@SpringBootApplication", "@Autowired",
    ],
    "Quarkus": [
        "quarkus", "io.quarkus", "@QuarkusTest", "application.properties", "@ConfigProperty",
    ],
    "Micronaut": [
        "micronaut", "io.micronaut", "@Controller", "@Inject", "@Client", "application.yml",
    ],
    "Jakarta EE": ["jakarta", "javax.servlet", "@WebServlet", "@EJB", "@Entity", "persistence.xml"],
    "Gin": ["gin-gonic/gin", "gin.Engine", "gin.Context", "gin.Default()", "r := gin."],
    "Echo": ["labstack/echo", "echo.New()", "echo.Context", "e := echo.", "e.GET(", "e.POST("],
    "Fiber": [
        "gofiber/fiber", "fiber.New()", "fiber.App", "app := fiber.", "app.Get(", "app.Post(",
    ],
    "Gorilla": [
        "gorilla/mux", "gorilla/websocket", "mux.NewRouter()", "r := mux.", "r.HandleFunc(",
    ],
    "Rails": [
        "rails", "config/routes.rb", "ActiveRecord", "gemfile", "gem 'rails'", "app/controllers/",
        "app/models/", "app/views/",
    ],
    "Sinatra": ["sinatra", "require 'sinatra'", "get '/'", "post '/'", "Sinatra::Base"],
    "Laravel": [
        "laravel", "artisan", 'Illuminate\\', "app/Http/Controllers/", "composer.json",
        "routes/web.php", "public/index.php",
    ],
    "Symfony": [
        "symfony", "symfony.lock", "bin/console", r"Symfony\Component", r"Symfony\Bundle",
        "config/services.yaml",
    ],
    "CodeIgniter": [
        "codeigniter", "system/core/CodeIgniter.php", "application/controllers/",
        "application/models/",
    ],
    "ASP.NET": [
        "aspnet", "Microsoft.AspNetCore", "IActionResult", "Controller", ".csproj", ".sln",
        "Startup.cs", "Program.cs", "appsettings.json",
    ],
    "Blazor": [
        "blazor", "@page", "Microsoft.AspNetCore.Components", "_Imports.razor", "App.razor",
        "@code",
    ],
    "Entity Framework": [
        "EntityFramework", "Microsoft.EntityFrameworkCore", "DbContext", "OnModelCreating",
        "DbSet<",
    ],
    "Electron": [
        "electron", "main.js", "preload.js", "renderer.js", "app.whenReady()", "BrowserWindow",
        "electron-builder",
    ],
    "React Native": [
        "react-native", "import { View, Text } from 'react-native'", "AppRegistry", "StyleSheet",
        "expo",
    ],
    "Flutter": [
        "flutter", "pubspec.yaml", "dart", "Widget build", "MaterialApp", "StatelessWidget",
        "StatefulWidget",
    ],
    "TensorFlow": [
        "tensorflow", "import tensorflow as tf", "tf.", "keras", "tf.keras", "tensorflow.keras",
    ],
    "PyTorch": ["pytorch", "torch", "import torch", "nn.Module", "torch.nn", "torch.optim"],
    "Pandas": ["pandas", "import pandas as pd", "pd.DataFrame", "pd.read_csv", "pd.Series"],
    "NumPy": ["numpy", "import numpy as np", "np.array", "np.zeros", "np.ones"],
    "AWS CDK": ["aws-cdk", "cdk.Stack", "cdk.Construct", "cdk.app", "cdk.json", "@aws-cdk"],
    "Serverless Framework": [
        "serverless.yml", "serverless.yaml", "serverless framework", "sls deploy",
    ],
    "Pulumi": ["pulumi", "Pulumi.yaml", "pulumi.Config", "pulumi up", "import * as pulumi"],
}

STRONG_EVIDENCE = {
    "Django": [
        r"from\s+django\.", r"import\s+django", r"settings\.py", "INSTALLED_APPS", "MIDDLEWARE",
        "urlpatterns",
    ],
    "Flask": [r"from\s+flask\s+import", r"app\s*=\s*Flask\(", r"@app\.route", r"render_template\("],
    "FastAPI": [r"from\s+fastapi\s+import", r"app\s*=\s*FastAPI\(", r"@app\.get", r"@app\.post"],
    "SQLAlchemy": [
        r"from\s+sqlalchemy\s+import", r"class\s+\w+\(.*Base\)", r"Base\s*=\s*declarative_base\(\)",
        r"db\s*=\s*SQLAlchemy\(", r"Column\(", r"relationship\(", "flask_sqlalchemy",
    ],
    "React": [
        r"import\s+React\s+from", r"React\.Component", r"useState\(", r"useEffect\(",
        r"class\s+\w+\s+extends\s+React\.Component",
    ],
    "Vue.js": [
        r"import\s+Vue\s+from", r"new\s+Vue\({", r"createApp\(", r"<template>.*<\/template>",
    ],
    "Angular": [
        r"import\s+{\s*Component", r"@Component\({", r"@NgModule\({", r"platformBrowserDynamic\(\)",
    ],
    "Express": [
        'const\\s+express\\s*=\\s*require\\([\'\\"]express[\'\\"]\\)', r"import\s+express\s+from",
        r"app\.listen\(\d+", 'app\\.(get|post|put|delete)\\([\'\\"]\\/\\w*[\'\\"]\\s*,',
    ],
    "Spring": [
        "@SpringBootApplication", "@RestController", "@Service", "@Autowired",
        r"SpringApplication\.run",
    ],
    "Rails": [
        r"class\s+\w+Controller\s*<\s*ApplicationController", r"Rails\.application",
        "ActiveRecord::Base", r"rails\s+generate", r"bundle\s+exec\s+rails",
    ],
    "Laravel": [
        r"namespace\s+App\\Http\\Controllers", 'Illuminate\\\\', 'use\\s+Illuminate\\\\',
        r"artisan\s+",
    ],
    "TensorFlow": [
        r"import\s+tensorflow\s+as\s+tf", r"tf\.keras", r"tf\.Session\(\)", r"tf\.placeholder\(",
    ],
    "PyTorch": [r"import\s+torch", r"torch\.nn", r"torch\.optim", r"class\s+\w+\(nn\.Module\)"],
}

REQUIREMENTS = {
    "Django": ["django"],
    "Flask": ["flask"],
    "FastAPI": ["fastapi"],
    "Pyramid": ["pyramid"],
    "Tornado": ["tornado"],
    "SQLAlchemy": ["sqlalchemy", "flask-sqlalchemy", "flask_sqlalchemy"],
    "Celery": ["celery"],
}

PACKAGE_JSON = {
    "React": ["react", "react-dom"],
    "Vue.js": ["vue"],
    "Angular": ["@angular/core"],
    "Next.js": ["next"],
    "Express": ["express"],
    "NestJS": ["@nestjs/core"],
    "Svelte": ["svelte"],
}

SOURCE_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "rb": "ruby",
    "php": "php",
    "java": "java",
    "cs": "csharp",
    "go": "go",
    "dart": "dart",
}

REQUIRED_LANGUAGE = {
    "Django": "python",
    "Flask": "python",
    "FastAPI": "python",
    "Pyramid": "python",
    "Tornado": "python",
    "SQLAlchemy": "python",
    "Celery": "python",
    "React": "javascript",
    "Vue.js": "javascript",
    "Angular": "javascript",
    "Next.js": "javascript",
    "Express": "javascript",
    "NestJS": "javascript",
    "Svelte": "javascript",
    "jQuery": "javascript",
    "Spring": "java",
    "Quarkus": "java",
    "Micronaut": "java",
    "Jakarta EE": "java",
    "Gin": "go",
    "Echo": "go",
    "Fiber": "go",
    "Gorilla": "go",
    "Rails": "ruby",
    "Sinatra": "ruby",
    "Laravel": "php",
    "Symfony": "php",
    "CodeIgniter": "php",
    "ASP.NET": "csharp",
    "Blazor": "csharp",
    "Entity Framework": "csharp",
    "React Native": "javascript",
    "Flutter": "dart",
    "TensorFlow": "python",
    "PyTorch": "python",
    "Pandas": "python",
    "NumPy": "python",
}
