"""Word lists that results depend on."""

from __future__ import annotations

# Words of layers, web and storage techniques, and noise.
ARCHITECTURE = (
    "impl", "implementation", "service", "services", "rest", "controller", "resource", "endpoint", "api", "client", "server", "provider", "consumer",
    "handler", "dispatcher", "filter", "interceptor", "middleware", "component", "bean", "configuration", "config", "context",
    "factory", "builder", "manager", "helper", "util", "utils", "adapter", "converter", "mapper", "wrapper", "proxy", "delegate",
    "repository", "dao", "entity", "entities", "model", "domain", "dto", "vo", "po", "request", "response", "payload", "params", "param", "argument",
    "action", "form", "page", "view", "html", "jsp", "jsf", "http", "https", "uri", "url", "json", "xml", "yaml", "get", "set", "post", "put", "delete", "patch",
    "jpa", "hibernate", "jdbc", "orm", "sql", "nosql", "mongo", "table", "column", "row", "schema",
    "data", "value", "values", "type", "types", "name", "names", "id", "ids", "base", "default", "common", "core",
)

# Further words for texts that are to show the domain only.
DOMAIN = (
    "svc", "repo", "processor", "utility", "shared", "abstract", "properties", "property", "gateway", "listener", "db", "database", "datasource",
    "servlet", "spring", "springboot", "jakarta", "javaee", "ejb", "jms", "soap", "test", "tests", "testing", "mock", "stub",
    "log", "logger", "logging", "trace", "tracing", "metric", "metrics",
)

# Words of the programming language.
LANGUAGE = (
    "public", "private", "protected", "static", "final", "void", "return", "if", "else", "for", "while", "new", "try", "catch", "throw", "throws",
    "class", "interface", "extends", "implements", "import", "package", "string", "int", "boolean", "list", "map", "arraylist", "hashmap",
    "override", "null", "true", "false", "this", "object",
)

# Parts of class names of the presentation and plumbing layers.
PLUMBING = ("web", "servlet", "jsf", "jsp", "controller", "action", "view", "filter", "listener", "config", "dto", "util", "utils", "helper", "common", "facade", "gateway", "interceptor", "producer")

# Parts of packages that hold data or tools.
NOISE_PACKAGES = (".dto", ".vo", ".po", ".entity", ".entities", ".model", ".domain", ".common", ".util", ".utils", ".constant", ".constants", ".config")

# Library prefixes that tie everything together.
LIBRARIES = ("java.lang", "java.util", "java.io", "java.time", "java.net", "javax.servlet", "jakarta.servlet", "javax.ws", "jakarta.ws", "javax.persistence", "jakarta.persistence", "org.slf4j", "org.apache", "com.fasterxml", "org.springframework")

# Prefixes and parts of classes that aren't the application's.
FOREIGN_PREFIXES = ("java.", "javax.", "jakarta.", "org.springframework.", "org.apache.", "com.fasterxml.", "ch.qos.logback.")
FOREIGN_PARTS = ("test", "mock", "jmeter", "benchmark", "example")


def stopwords(extra: tuple[str, ...] = (), domain: bool = True) -> tuple[str, ...]:
    """All lists that apply, each word once, in order."""
    return tuple(dict.fromkeys((*LANGUAGE, *ARCHITECTURE, *(DOMAIN if domain else ()), *(w.strip().lower() for w in extra if w.strip()))))
