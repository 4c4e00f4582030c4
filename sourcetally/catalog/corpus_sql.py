"""Source files laid over ``documents``: one statement that Spark and DuckDB both run.

The given tables hold prose, so each document becomes one file of a source tree; its text is
kept whole.  Paths, names and snippets are input data only.
"""

CODE_FILES = """
WITH s AS (
  SELECT doc_id, source, text,
         CAST((doc_id * 7 + floor(doc_id / 20)) % 16 AS INT) AS slot,
         CAST(floor(doc_id / 80) % 4 AS INT) AS dirno,
         CAST(floor(doc_id / 320) AS INT) AS part,
         CAST((doc_id * 3 + 1) % 20 AS INT) AS peer
  FROM {documents})
SELECT doc_id, 'corpus' AS root,
  'corpus/' || source || '/' ||
  CASE dirno WHEN 0 THEN '' WHEN 1 THEN 'api/' WHEN 2 THEN 'web/' ELSE 'api/v2/' END ||
  'm' || CAST(part AS STRING) || '/' ||
  CASE slot WHEN 0 THEN 'app.py' WHEN 1 THEN 'package.json' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'index.js'
    WHEN 4 THEN 'main.py' WHEN 5 THEN 'routes.js' WHEN 6 THEN 'deployment.yaml' WHEN 7 THEN 'UserController.java'
    WHEN 8 THEN 'index.html' WHEN 9 THEN 'style.css' WHEN 10 THEN 'README.md' WHEN 11 THEN '.env'
    WHEN 12 THEN 'photo.png' WHEN 13 THEN '__init__.py' WHEN 14 THEN 'test_app.py' ELSE 'worker.py' END AS path,
  CASE slot
    WHEN 0 THEN 'from fastapi import FastAPI' || chr(10) || 'import os.path as p' || chr(10) || '@app.get("/users/{{id}}")' || chr(10)
             || 'requests.get("http://src' || CAST(peer AS STRING) || '/api/users/1")'
    WHEN 1 THEN CASE WHEN part % 2 = 0 THEN '{{"dependencies":{{"react":"^18","jest":"1"}},"devDependencies":{{"jest":"2"}},"description":"' ||
      replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'),
              chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"}}' ELSE '{{bad' || chr(10) || text END
    WHEN 2 THEN 'FROM python:3' || chr(10) || 'RUN pip install x' || chr(10) || 'EXPOSE 80'
    WHEN 3 THEN 'app.post("/items", h)' || chr(10) || 'axios.get("https://src' || CAST(peer AS STRING) || '.internal/v1/items")' || chr(10) || 'fetch("/img/logo.png")'
    WHEN 4 THEN 'import flask' || chr(10) || '@app.route("/health")' || chr(10) || 'if __name__ == "__main__":' || chr(10) || '  pass'
    WHEN 6 THEN 'apiVersion: v1' || chr(10) || 'kind: Deployment' || chr(10) || 'containerPort: 80'
    WHEN 7 THEN '@GetMapping("/login")' || chr(10) || 'webClient.get().uri("/api/token")'
    WHEN 8 THEN '<div id="a"></div><script></script>'
    WHEN 14 THEN 'import pytest' || chr(10) || 'def test_a(): pass'
    WHEN 15 THEN 'from kafka import KafkaProducer' || chr(10) || 'x = "KAFKA_URL"' || chr(10) || 'publish("topic")'
    ELSE '' END || CASE WHEN slot = 1 THEN '' ELSE chr(10) || text END AS content
FROM s
"""
