"""Detection dictionaries, as data.

Everything in this module is a fixed value: the names, patterns, weights and
their order decide the results (order breaks ties), so they are stated as they
have to be.  No logic lives here; ``sources.patterns`` turns the dictionaries
into tables, and every operator takes a dictionary as a parameter.
"""

# --------------------------------------------------------------------------
# Framework dictionary.  name -> file names, imported modules,
# content substrings, weight.  Eight groups, merged in this order.
# --------------------------------------------------------------------------

WEB = {
    "django": {"weight": 0.8,
               "files": ["manage.py", "settings.py", "urls.py", "wsgi.py", "asgi.py"],
               "imports": ["django"],
               "content": ["DJANGO_SETTINGS_MODULE", "django.db.models", "django.urls"]},
    "flask": {"weight": 0.7,
              "files": ["app.py", "wsgi.py", "application.py"],
              "imports": ["flask", "Flask"],
              "content": ["from flask import", "import flask", "Flask(__name__)", "@app.route"]},
    "fastapi": {"weight": 0.7,
                "files": ["app.py", "main.py"],
                "imports": ["fastapi", "FastAPI"],
                "content": ["from fastapi import", "import fastapi", "FastAPI(", "@app.get"]},
    "tornado": {"weight": 0.7,
                "imports": ["tornado"],
                "content": ["tornado.web", "tornado.ioloop", "RequestHandler"]},
    "aiohttp": {"weight": 0.7,
                "imports": ["aiohttp"],
                "content": ["web.Application()", "app.router.add_get", "aiohttp.web"]},
    "bottle": {"weight": 0.6,
               "imports": ["bottle"],
               "content": ["from bottle import", "@route", "run(host="]},
    "falcon": {"weight": 0.6,
               "imports": ["falcon"],
               "content": ["import falcon", "falcon.App", "falcon.API"]},
    "cherrypy": {"weight": 0.6,
                 "imports": ["cherrypy"],
                 "content": ["import cherrypy", "@cherrypy.expose"]},
    "pyramid": {"weight": 0.6,
                "imports": ["pyramid"],
                "content": ["from pyramid.config import", "config.add_route"]},
    "starlette": {"weight": 0.6,
                  "imports": ["starlette"],
                  "content": ["from starlette", "ASGIApp"]},
    "sanic": {"weight": 0.7,
              "imports": ["sanic"],
              "content": ["from sanic import", "app = Sanic", "@app.route"]},
}

JAVASCRIPT = {
    "react": {"weight": 0.9,
              "files": ["package.json", "jsx", "tsx", "react-scripts", "src/App.js", "src/index.js"],
              "imports": ["react", "react-dom"],
              "content": ['"react":', '"react-dom":', "import React", 'from "react"', "ReactDOM.render"]},
    "angular": {"weight": 0.9,
                "files": ["angular.json", "package.json", "tsconfig.json", "src/app/app.module.ts"],
                "content": ['"@angular/core":', "ng new", "ng generate", "NgModule"]},
    "vue": {"weight": 0.9,
            "files": ["vue.config.js", "package.json"],
            "imports": ["vue"],
            "content": ['"vue":', "new Vue(", "createApp(", "<template>", "export default {"]},
    "svelte": {"weight": 0.8,
               "files": ["svelte.config.js", "package.json"],
               "imports": ["svelte"],
               "content": ['"svelte":', "<script>", "<style>", "$:"]},
    "next": {"weight": 0.8,
             "files": ["next.config.js", "package.json", "pages", "pages/index.js"],
             "imports": ["next"],
             "content": ['"next":', "getStaticProps", "getServerSideProps", "NextPage"]},
    "nuxt": {"weight": 0.8,
             "files": ["nuxt.config.js", "package.json", "pages", "pages/index.vue"],
             "imports": ["nuxt"],
             "content": ['"nuxt":', "export default {", "<template>", "asyncData"]},
    "jquery": {"weight": 0.6,
               "imports": ["jquery"],
               "content": ["$(", "jQuery(", ".ready(", ".click(", ".ajax("]},
    "backbone": {"weight": 0.6,
                 "imports": ["backbone"],
                 "content": ["Backbone.", "Backbone.Model", "Backbone.View"]},
    "ember": {"weight": 0.7,
              "files": ["ember-cli-build.js", "package.json"],
              "imports": ["ember"],
              "content": ['"ember":', "Ember."]},
}

DATA_SCIENCE = {
    "pytorch": {"weight": 0.8,
                "imports": ["torch", "pytorch"],
                "content": ["import torch", "from torch import", "torch.nn", "torch.optim"]},
    "tensorflow": {"weight": 0.8,
                   "imports": ["tensorflow", "tf"],
                   "content": ["import tensorflow", "import tf", "tf.keras", "tf.data"]},
    "sklearn": {"weight": 0.7,
                "imports": ["sklearn", "scikit-learn", "scikit_learn"],
                "content": ["from sklearn import", "sklearn.model_selection", "train_test_split"]},
    "pandas": {"weight": 0.6,
               "imports": ["pandas", "pd"],
               "content": ["import pandas", "pd.DataFrame", "pd.read_csv"]},
    "numpy": {"weight": 0.5,
              "imports": ["numpy", "np"],
              "content": ["import numpy", "np.array", "np.zeros"]},
    "matplotlib": {"weight": 0.5,
                   "imports": ["matplotlib", "plt"],
                   "content": ["import matplotlib", "plt.figure", "plt.plot"]},
    "keras": {"weight": 0.7,
              "imports": ["keras"],
              "content": ["import keras", "keras.layers", "Sequential"]},
    "xgboost": {"weight": 0.7,
                "imports": ["xgboost"],
                "content": ["import xgboost", "XGBClassifier", "XGBRegressor"]},
    "lightgbm": {"weight": 0.7,
                 "imports": ["lightgbm"],
                 "content": ["import lightgbm", "LGBMClassifier", "LGBMRegressor"]},
    "pyspark": {"weight": 0.8,
                "imports": ["pyspark"],
                "content": ["import pyspark", "SparkContext", "SparkSession"]},
    "scipy": {"weight": 0.5,
              "imports": ["scipy"],
              "content": ["import scipy", "scipy.stats", "scipy.optimize"]},
    "nltk": {"weight": 0.7,
             "imports": ["nltk"],
             "content": ["import nltk", "nltk.tokenize", "nltk.corpus"]},
    "spacy": {"weight": 0.7,
              "imports": ["spacy"],
              "content": ["import spacy", "nlp = spacy.load"]},
    "huggingface_transformers": {"weight": 0.8,
                                 "imports": ["transformers"],
                                 "content": ["from transformers import", "AutoModel", "AutoTokenizer"]},
}

TESTING = {
    "pytest": {"weight": 0.7,
               "files": ["pytest.ini", "conftest.py", "test_*.py", "*_test.py"],
               "imports": ["pytest"],
               "content": ["import pytest", "@pytest.fixture", "def test_"]},
    "unittest": {"weight": 0.6,
                 "imports": ["unittest"],
                 "content": ["import unittest", "unittest.TestCase", "class Test"]},
    "nose": {"weight": 0.6,
             "files": [".noserc", "nose.cfg"],
             "imports": ["nose"],
             "content": ["import nose", "from nose"]},
    "jest": {"weight": 0.7,
             "files": ["jest.config.js", "*.test.js", "*.spec.js"],
             "content": ['"jest":', "describe(", "it(", "test(", "expect("]},
    "mocha": {"weight": 0.7,
              "files": ["mocha.opts", ".mocharc.js", ".mocharc.json"],
              "imports": ["mocha"],
              "content": ['"mocha":', "describe(", "it(", "before(", "after("]},
    "jasmine": {"weight": 0.7,
                "files": ["jasmine.json", "spec/support/jasmine.json"],
                "imports": ["jasmine"],
                "content": ['"jasmine":', "describe(", "it(", "beforeEach("]},
    "cypress": {"weight": 0.8,
                "files": ["cypress.json", "cypress.config.js", "cypress/"],
                "imports": ["cypress"],
                "content": ['"cypress":', "cy.visit", "cy.get("]},
    "selenium": {"weight": 0.7,
                 "imports": ["selenium"],
                 "content": ["webdriver", "By.", "driver.find_element"]},
    "playwright": {"weight": 0.8,
                   "files": ["playwright.config.js", "playwright.config.ts"],
                   "imports": ["playwright"],
                   "content": ['"playwright":', "page.goto", "await browser.newPage"]},
}

DATABASE = {
    "sqlalchemy": {"weight": 0.7,
                   "imports": ["sqlalchemy"],
                   "content": ["from sqlalchemy import", "Base =", "Column(", "relationship("]},
    "django_orm": {"weight": 0.7,
                   "imports": ["django.db"],
                   "content": ["models.Model", "models.CharField", "models.ForeignKey"]},
    "peewee": {"weight": 0.6,
               "imports": ["peewee"],
               "content": ["from peewee import", "class Meta:", "Model)"]},
    "mongoengine": {"weight": 0.7,
                    "imports": ["mongoengine"],
                    "content": ["from mongoengine import", "Document)", "StringField("]},
    "prisma": {"weight": 0.8,
               "files": ["schema.prisma", "prisma/schema.prisma"],
               "content": ["generator client", "datasource db", "model "]},
    "sequelize": {"weight": 0.7,
                  "imports": ["sequelize"],
                  "content": ['"sequelize":', "const sequelize", "define("]},
    "knex": {"weight": 0.7,
             "imports": ["knex"],
             "content": ['"knex":', "knex({", "knex.schema"]},
    "typeorm": {"weight": 0.8,
                "files": ["ormconfig.json"],
                "imports": ["typeorm"],
                "content": ['"typeorm":', "@Entity(", "@Column("]},
}

API = {
    "graphql": {"weight": 0.7,
                "imports": ["graphql", "graphene"],
                "content": ["from graphql import", "type Query {", "type Mutation {"]},
    "apollo": {"weight": 0.7,
               "imports": ["apollo"],
               "content": ['"apollo-server":', "ApolloServer", "gql`"]},
    "rest_framework": {"weight": 0.7,
                       "imports": ["rest_framework"],
                       "content": ["from rest_framework import", "APIView", "serializers."]},
    "express_graphql": {"weight": 0.7,
                        "imports": ["express-graphql"],
                        "content": ['"express-graphql":', "graphqlHTTP"]},
    "swagger": {"weight": 0.6,
                "files": ["swagger.json", "swagger.yaml", "openapi.yaml"],
                "content": ["swagger:", "openapi:"]},
    "grpc": {"weight": 0.8,
             "files": [".proto"],
             "imports": ["grpc"],
             "content": ["import grpc", "service ", "rpc "]},
}

DEVOPS = {
    "docker": {"weight": 0.8,
               "files": ["Dockerfile", "docker-compose.yml", ".dockerignore"],
               "content": ["FROM ", "RUN ", "COPY ", "EXPOSE ", "CMD ["]},
    "kubernetes": {"weight": 0.8,
                   "files": ["deployment.yaml", "service.yaml", "pod.yaml", "k8s/"],
                   "content": ["apiVersion:", "kind: Deployment", "kind: Service"]},
    "terraform": {"weight": 0.8,
                  "files": [".tf", "terraform.tfstate", "terraform.tfvars"],
                  "content": ['resource "', 'provider "', "terraform {"]},
    "ansible": {"weight": 0.8,
                "files": ["playbook.yml", "ansible.cfg", "inventory"],
                "content": ["- name:", "hosts:", "tasks:"]},
    "github_actions": {"weight": 0.7,
                       "files": [".github/workflows/", ".github/actions/"],
                       "content": ["on:", "jobs:", "steps:", "uses: "]},
    "gitlab_ci": {"weight": 0.7,
                  "files": [".gitlab-ci.yml"],
                  "content": ["stages:", "script:", "image:"]},
    "jenkins": {"weight": 0.7,
                "files": ["Jenkinsfile"],
                "content": ["pipeline {", "stage(", "agent {"]},
    "circleci": {"weight": 0.7,
                 "files": [".circleci/config.yml"],
                 "content": ["version: 2", "jobs:", "workflows:"]},
    "aws": {"weight": 0.6,
            "files": ["cloudformation.yaml", "aws-sam"],
            "imports": ["boto3", "aws-sdk"],
            "content": ["AWS::", "aws-sdk", "boto3"]},
    "azure": {"weight": 0.6,
              "files": ["azuredeploy.json", "azure-pipelines.yml"],
              "imports": ["azure"],
              "content": ["Microsoft.", "azure-", "azure_"]},
    "gcp": {"weight": 0.6,
            "files": ["app.yaml", "Deployment.yaml"],
            "imports": ["google.cloud"],
            "content": ["google-cloud", "gcloud", "GCP_"]},
}

BUILD = {
    "webpack": {"weight": 0.7,
                "files": ["webpack.config.js"],
                "content": ['"webpack":', "module.exports", "entry:", "output:"]},
    "babel": {"weight": 0.7,
              "files": [".babelrc", "babel.config.js"],
              "content": ['"@babel/core":', "presets:", "plugins:"]},
    "eslint": {"weight": 0.6,
               "files": [".eslintrc", ".eslintrc.js", ".eslintrc.json"],
               "content": ['"eslint":', "rules:", "extends:"]},
    "prettier": {"weight": 0.6,
                 "files": [".prettierrc", ".prettierrc.js", ".prettierrc.json"],
                 "content": ['"prettier":', "tabWidth:", "singleQuote:"]},
    "gulp": {"weight": 0.7,
             "files": ["gulpfile.js"],
             "content": ['"gulp":', "gulp.task", "gulp.src"]},
    "grunt": {"weight": 0.7,
              "files": ["Gruntfile.js"],
              "content": ['"grunt":', "grunt.initConfig", "grunt.registerTask"]},
    "poetry": {"weight": 0.8,
               "files": ["poetry.lock", "pyproject.toml"],
               "content": ["[tool.poetry]", "poetry.core", "poetry add"]},
    "setuptools": {"weight": 0.7,
                   "files": ["setup.py", "setup.cfg"],
                   "content": ["setuptools.setup", "install_requires", "packages=find_packages()"]},
    "pip": {"weight": 0.6,
            "files": ["requirements.txt", "requirements-dev.txt"],
            "content": ["pip install", "pip freeze"]},
    "npm": {"weight": 0.7,
            "files": ["package.json", "package-lock.json"],
            "content": ['"dependencies":', '"devDependencies":', '"scripts":']},
    "yarn": {"weight": 0.7,
             "files": ["yarn.lock"],
             "content": ['"yarn":', "yarn add", "yarn install"]},
    "make": {"weight": 0.6,
             "files": ["Makefile"],
             "content": [".PHONY:", "all:", "install:", "build:"]},
}

FRAMEWORK_GROUPS = [WEB, JAVASCRIPT, DATA_SCIENCE, TESTING, DATABASE, API, DEVOPS, BUILD]

# --------------------------------------------------------------------------
# Microservice indicators and communication styles.
# --------------------------------------------------------------------------

MICROSERVICE = {
    "docker": {"weight": 1.0,
               "files": ["Dockerfile", "docker-compose.yml", ".dockerignore"]},
    "kubernetes": {"weight": 1.0,
                   "files": ["k8s", "kubernetes", "deployment.yaml", "service.yaml", "ingress.yaml",
                             "values.yaml", "helm"],
                   "content": ["apiVersion:", "kind: Deployment", "kind: Service", "kind: Ingress"]},
    "api_gateway": {"weight": 0.8,
                    "files": ["gateway", "proxy", "nginx.conf", "traefik.toml", "zuul", "ambassador"],
                    "content": ["proxy_pass", "upstream", "location", "PathPrefix", "routes"]},
    "service_discovery": {"weight": 0.8,
                          "files": ["consul", "eureka", "zookeeper", "etcd", "service-registry"],
                          "content": ["service_name", "service-name", "discovery", "registry"]},
    "message_queue": {"weight": 0.7,
                      "files": ["rabbitmq", "kafka", "redis", "activemq", "sqs", "pubsub"],
                      "content": ["KAFKA_", "RABBITMQ_", "REDIS_", "message broker", "message queue",
                                  "pub/sub"]},
    "microservice_config": {"weight": 0.6,
                            "files": [".env", "config.yaml", "config.json", "application.properties",
                                      "application.yml"],
                            "content": ["SERVICE_", "ENDPOINT_", "API_URL", "service:", "endpoints:"]},
    "health_check": {"weight": 0.7,
                     "files": ["health", "healthcheck"],
                     "content": ["/health", "/status", "healthcheck", "readiness", "liveness"]},
    "containerization": {"weight": 0.8,
                         "files": ["container", "pod", "swarm", "ecs", "fargate"],
                         "content": ["container_name", "image:", "containerPort"]},
    "service_boundary": {"weight": 0.6,
                         "files": ["boundary", "domain", "context"],
                         "content": ["bounded context", "domain-driven", "service boundary"]},
}

COMMUNICATION = {
    "rest_api": {"weight": 0.7,
                 "content": ["@app.route", "@router.get", "axios.get", "fetch(", "http.get",
                             "RestController"]},
    "grpc": {"weight": 0.9,
             "content": ["service", "rpc", "protobuf", "proto3"]},
    "graphql": {"weight": 0.8,
                "content": ["query {", "type Query", "gql`", "graphql.executeQuery"]},
    "event_based": {"weight": 0.8,
                    "content": ["publish", "subscribe", "emit", "on(", "event-driven"]},
    "soap": {"weight": 0.6,
             "content": ["<soap:", "wsdl", "SoapClient", "SoapService"]},
    "websocket": {"weight": 0.7,
                  "content": ["WebSocket", "socket.on", "socket.emit", "ws.send"]},
}

# communication style -> label of the relationship it causes
RELATIONSHIP_LABELS = {
    "rest_api": "REST", "grpc": "gRPC", "graphql": "GraphQL",
    "event_based": "Event-based", "soap": "SOAP", "websocket": "WebSocket",
}

# relationship label -> arrow in an edge list (anything else: "-->")
EDGE_ARROWS = {
    "Event-based": "-.->|event|", "gRPC": "===>|gRPC|", "GraphQL": "--o|GraphQL|",
}

# --------------------------------------------------------------------------
# Ignore presets.
# --------------------------------------------------------------------------

DEFAULT_IGNORE = [
    ".git", ".github", ".svn", ".hg", ".bzr",
    ".vscode", "__pycache__", ".idea", ".vs", ".settings", ".project", ".classpath",
    "venv", "env", ".env", ".virtualenv", ".venv", "virtualenv", "ENV", "node_modules",
    "dist", "build", "target", "out", "bin",
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll",
    "*.egg-info", "*.egg", "*.whl", "*.jar", "*.war",
    ".DS_Store", "Thumbs.db", ".directory",
    ".cache", ".config", ".azure", ".aws", ".android",
    ".gradle", ".nuget", ".m2", ".npm", ".yarn",
    "AppData", "Local Settings", "Application Data", ".anaconda", ".brave_automation",
    "Temporary Internet Files", "Temp", "tmp",
    "data", "dataset", "datasets", "large_files", "logs", "log", "archive", "bak", "backup",
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.bmp",
    "*.mp3", "*.mp4", "*.mov", "*.avi", "*.wmv",
    "*.zip", "*.tar", "*.gz", "*.bz2", "*.xz", "*.rar",
]

HOME_IGNORE = [
    ".cache", ".config", ".azure", ".aws", ".android",
    ".vscode", ".idea", ".git", ".svn", "node_modules",
    "site-packages", "__pycache__", ".ipynb_checkpoints",
    "AppData", "Local Settings", "Application Data",
    "Temporary Internet Files", "Temp", "tmp",
    ".gradle", ".nuget", ".m2", ".npm", ".yarn",
    "Downloads", "Documents", "Pictures", "Music", "Videos",
    "OneDrive", "Dropbox", "Google Drive", "iCloud",
]

DESKTOP_IGNORE = [
    "node_modules", "venv", ".venv", "__pycache__",
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll",
    ".git", ".svn", ".hg", ".DS_Store",
]

# --------------------------------------------------------------------------
# File name lists.
# --------------------------------------------------------------------------

KEY_FILES = [
    "main.py", "app.py", "run.py", "server.py", "setup.py", "requirements.txt",
    "pyproject.toml", "Pipfile", "Pipfile.lock", "pytest.ini", "conftest.py",
    "manage.py", "wsgi.py", "asgi.py", "settings.py", "urls.py", "models.py",
    "views.py", "tox.ini", "__main__.py", "config.py", "utils.py",
    "package.json", "package-lock.json", "yarn.lock", "tsconfig.json",
    "next.config.js", "nuxt.config.js", "angular.json", "vue.config.js",
    "webpack.config.js", "rollup.config.js", ".babelrc", ".eslintrc",
    "index.js", "main.js", "server.js", "app.js", "index.ts", "main.ts",
    ".env", ".env.example", ".gitignore", ".gitattributes", ".editorconfig",
    "README.md", "LICENSE", "CONTRIBUTING.md", "CHANGELOG.md",
    "Makefile", "CMakeLists.txt", ".gitlab-ci.yml", ".travis.yml",
    ".github/workflows", "azure-pipelines.yml", "Jenkinsfile",
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "k8s", "kubernetes", "deployment.yaml", "service.yaml",
    "pom.xml", "build.gradle", "settings.gradle", "gradlew",
    "AndroidManifest.xml", "build.xml", "ivy.xml",
    "project.json", "*.csproj", "*.vbproj", "*.fsproj", "app.config",
    "web.config", "NuGet.Config", "packages.config",
    "Gemfile", "Rakefile", "Guardfile", "config.ru",
    "composer.json", "composer.lock", "artisan", "wp-config.php",
    "go.mod", "go.sum", "main.go",
    "Cargo.toml", "Cargo.lock",
    "Package.swift", "Info.plist", "project.pbxproj",
    "pubspec.yaml", "pubspec.lock",
]

MEDIA_SUFFIXES = [".jpg", ".png", ".gif", ".svg", ".ico", ".woff", ".ttf", ".eot",
                  ".mp3", ".mp4", ".avi", ".mov", ".pdf", ".zip", ".tar.gz", ".exe"]

IMPORTANT_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx", ".json", ".yml", ".yaml",
                      ".html", ".htm", ".css", ".java", ".kt", ".scala", ".xml"]

ENDPOINT_SUFFIXES = [".py", ".js", ".ts", ".java", ".kt", ".scala", ".rb", ".php"]

CALL_SUFFIXES = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".kt", ".scala", ".rb", ".php"]

# language -> suffixes; the order is the tie order of the primary language
LANGUAGES = {
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "java": [".java", ".kt", ".scala"],
    "html": [".html", ".htm"],
    "css": [".css", ".scss", ".sass"],
}

MAX_FILE_BYTES = 10 * 1024 * 1024      # larger files are not part of the corpus
MAX_CONTENT_BYTES = 5 * 1024 * 1024    # larger files get no framework analysis

# --------------------------------------------------------------------------
# Extraction expressions.  Written with explicit character
# classes so that Java and RE2 agree: W a word character, S white space, D a
# decimal digit, all in the Unicode sense.  Kept free of look-around.
# --------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
S = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
D = r"\p{Nd}"
Q = r"""['"]"""                        # a quote
T = r"""([^'"]+)"""                    # captured text up to a quote
VERB = "(get|post|put|delete|patch)"

MAIN_GUARD = f"if{S}+__name__{S}*=={S}*{Q}__main__{Q}"

IMPORT_FORMS = [
    rf"import{S}+([\p{{L}}\p{{N}}_.]+)(?:{S}+as{S}+[\p{{L}}\p{{N}}_.]+)?",
    rf"from{S}+([\p{{L}}\p{{N}}_.]+){S}+import{S}+(?:[\p{{L}}\p{{N}}_., *]+)",
]

# (framework, literal every match contains, expression, group of the method or 0, group of the path)
ENDPOINT_FORMS = [
    ("flask", "@app.route(", rf"@app\.route\({Q}{T}{Q}", 0, 1),
    ("flask", "@blueprint.route(", rf"@blueprint\.route\({Q}{T}{Q}", 0, 1),
    ("flask", "@api.route(", rf"@api\.route\({Q}{T}{Q}", 0, 1),
    ("fastapi", "@app.", rf"@app\.{VERB}\({Q}{T}{Q}", 1, 2),
    ("fastapi", "@router.", rf"@router\.{VERB}\({Q}{T}{Q}", 1, 2),
    ("fastapi", "@api.", rf"@api\.{VERB}\({Q}{T}{Q}", 1, 2),
    ("express", "app.", rf"app\.{VERB}\({Q}{T}{Q}", 1, 2),
    ("express", "router.", rf"router\.{VERB}\({Q}{T}{Q}", 1, 2),
    ("spring", "@RequestMapping(", rf"@RequestMapping\({Q}{T}{Q}", 0, 1),
    ("spring", "@GetMapping(", rf"@GetMapping\({Q}{T}{Q}", 0, 1),
    ("spring", "@PostMapping(", rf"@PostMapping\({Q}{T}{Q}", 0, 1),
    ("spring", "@PutMapping(", rf"@PutMapping\({Q}{T}{Q}", 0, 1),
    ("spring", "@DeleteMapping(", rf"@DeleteMapping\({Q}{T}{Q}", 0, 1),
    ("django", "path(", rf"path\({Q}{T}{Q}", 0, 1),
    ("django", "url(", rf"url\({Q}{T}{Q}", 0, 1),
    ("django", "re_path(", rf"re_path\({Q}{T}{Q}", 0, 1),
    ("rails", "get ", rf"get {Q}{T}{Q}", 0, 1),
    ("rails", "post ", rf"post {Q}{T}{Q}", 0, 1),
    ("rails", "put ", rf"put {Q}{T}{Q}", 0, 1),
    ("rails", "delete ", rf"delete {Q}{T}{Q}", 0, 1),
    ("generic", "api/", r"api/([a-zA-Z0-9/_-]+)", 0, 1),
    ("generic", "endpoint", rf"endpoint[s]?{Q}?{S}*[=:]{S}*{Q}{T}{Q}", 0, 1),
    ("generic", "route", rf"route[s]?{Q}?{S}*[=:]{S}*{Q}{T}{Q}", 0, 1),
]

# (language, literal every match contains, expression, groups that make up the URL, prefix of the URL)
CALL_FORMS = [
    ("python", "requests.", rf"requests\.{VERB}\({Q}{T}{Q}", [2], ""),
    ("python", "aiohttp.", rf"aiohttp\.{VERB}\({Q}{T}{Q}", [2], ""),
    ("javascript", "fetch(", rf"fetch\({Q}{T}{Q}", [1], ""),
    ("javascript", "axios.", rf"axios\.{VERB}\({Q}{T}{Q}", [2], ""),
    ("javascript", "http.", rf"http\.{VERB}\({Q}{T}{Q}", [2], ""),
    ("java", "RestTemplate().", rf"RestTemplate\(\)\.[^\n]*\({Q}{T}{Q}", [1], ""),
    ("java", "webClient.", rf"webClient\.(get|post|put|delete)\(\)\.(uri|url)\({Q}{T}{Q}", [3], ""),
    ("java", "HttpClient.", rf"HttpClient\.[^\n]*\({Q}{T}{Q}", [1], ""),
    ("urls", "://", rf"{Q}https?://([^/'\"]+)([^'\"]+){Q}", [1, 2], "http://"),
    ("urls", "http://localhost", rf"{Q}http://localhost[:]?{D}*{T}{Q}", [1], ""),
    ("urls", "127", rf"{Q}127[^\n]0[^\n]0[^\n]1[:]?{D}*{T}{Q}", [1], ""),
]

# terms of a URL that make it no service, terms that make it one, expressions that make it one
URL_SKIP_TERMS = [
    "googleapis.com", "amazonaws.com", "github.com", "gitlab.com",
    "cdn", "fonts.", "maps.", "static.", "assets.", "images.", "img.",
    "jquery", "bootstrap", "fontawesome", "polyfill", "gtag",
    ".png", ".jpg", ".gif", ".css", ".js", ".ico", ".svg", ".woff",
]
URL_SERVICE_TERMS = [
    "api", "service", "srv", "microservice", "micro-service",
    "gateway", "http://localhost", "127.0.0.1", "internal", "endpoint",
    "/v1/", "/v2/", "/v3/", "/rest/", "/graphql", "grpc://",
]
URL_SERVICE_FORMS = ["/api/", f"/v{D}+/", "/services?/", f"/{W}+/{W}+/", "/graphql", "/rest/"]

# endpoint type -> terms; the first type with a term in the lower-cased path wins
ENDPOINT_TYPES = {
    "health": ["/health", "/ping", "/status", "/heartbeat", "/alive"],
    "metrics": ["/metrics", "/stats", "/telemetry", "/monitor"],
    "auth": ["/auth", "/login", "/token", "/oauth", "/session"],
    "webhook": ["webhook", "callback"],
    "config": ["/config", "/settings", "/properties"],
    "admin": ["/admin"],
}

# lower bound -> confidence label; anything lower is the last label
CONFIDENCE_LEVELS = [(0.9, "Very High"), (0.75, "High"), (0.5, "Medium"), (0.25, "Low")]
LOWEST_CONFIDENCE = "Very Low"
