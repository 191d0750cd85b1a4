"""Render analysis prompts: one per file, or one per run as ordered segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.language import language_by_extension
from reviewlake.functions.severity import lookup
from reviewlake.operators.scoring import LANGUAGE_NAMES
from reviewlake.operators.skew import numbered

# The prompt texts.  {braces} mark what is filled in per file.
REVIEW_PERSONA = {
    "pyspark": "PySpark engineer specializing in big data, Spark optimization, and distributed processing",
    "python": "Python engineer specializing in clean code, performance, security, and best practices",
    "typescript": "TypeScript engineer specializing in type safety, async patterns, and Node.js best practices",
    "javascript": "JavaScript engineer specializing in modern ES6+, async patterns, and web best practices",
    "scala": "Scala engineer specializing in functional programming, type safety, and Spark optimization",
    "sql": "SQL engineer specializing in query optimization, indexing, and database performance",
    "terraform": "Terraform engineer specializing in Infrastructure as Code, cloud security, and best practices",
}
REVIEW_PERSONA_DEFAULT = "software engineer specializing in code quality, security, and best practices"
FOCUS = {
    "complexity": """Focus EXCLUSIVELY on code complexity issues:
1. Functions or methods that are too long or do too many things (single responsibility violations)
2. Deeply nested conditionals or loops (high cyclomatic complexity)
3. Hard-to-follow control flow, spaghetti logic, or excessive early returns
4. Large classes or modules that should be decomposed
5. Duplicated logic that increases maintenance burden
6. Overly complex expressions or data transformations that hurt readability""",
    "security": """Focus EXCLUSIVELY on security vulnerabilities:
1. Injection flaws (SQL, command, LDAP, XPath injection)
2. Authentication and authorization bypass
3. Insecure data handling (plaintext secrets, unencrypted sensitive data)
4. Insecure deserialization or unsafe eval/exec usage
5. Missing input validation or output encoding
6. Exposed credentials, tokens, or API keys in code
7. Insecure cryptography or weak hashing algorithms
8. Path traversal or arbitrary file access vulnerabilities""",
    "review": """Focus on semantic issues that require code understanding:
1. Logic errors and semantic bugs
2. Incorrect algorithm implementations or off-by-one errors
3. Performance problems (N+1 queries, blocking I/O in hot paths, memory leaks)
4. Race conditions, concurrency bugs, or incorrect async usage
5. Missing or incorrect error handling
6. Data flow issues (null dereferences, type mismatches)""",
    "quality": """Focus EXCLUSIVELY on code quality and maintainability:
1. Violations of SOLID principles
2. Missing or inadequate error handling and exception management
3. Poor naming conventions or misleading variable/function names
4. Lack of input validation at system boundaries
5. Hard-coded magic numbers or strings that should be constants
6. Missing null/undefined checks that could cause runtime failures
7. Overly coupled code with poor separation of concerns
8. Dead code, unreachable branches, or unused variables""",
}
REVIEW_PROMPT = """You are an expert {persona}.

You are performing a **{TYPE} ANALYSIS** of `{path}` as part of an automated pull request pipeline.

{focus}

Pattern-based checks (hardcoded secrets detected by regex, etc.) are handled by a separate rule engine — do not repeat those.

CODE TO ANALYZE ({path}):
```{language}
{content}
```

Return ONLY valid JSON in this exact format:
{
  "issues": [
    {
      "severity": "critical" | "high" | "medium" | "low" | "info",
      "category": "Security" | "Performance" | "Logic" | "Architecture" | "Complexity" | "Quality" | "Data Flow" | "Best Practice",
      "message": "Concise description of the issue",
      "lineNumber": 42,
      "suggestion": "Specific actionable fix",
      "reasoning": "Why this matters and what the impact is"
    }
  ]
}

If there are no issues in scope for this analysis type, return: {"issues": []}
Return ONLY the JSON object. No markdown, no explanation."""
EDITOR_PERSONA = {
    "pyspark": "PySpark code reviewer specializing in big data engineering, Spark optimization, and distributed processing",
    "python": "Python code reviewer specializing in clean code, performance, and best practices",
    "scala": "Scala code reviewer specializing in functional programming, type safety, and Spark optimization",
    "sql": "SQL code reviewer specializing in query optimization, indexing, and database performance",
    "terraform": "Terraform code reviewer specializing in Infrastructure as Code, cloud security, and best practices",
    "tf": "Terraform code reviewer specializing in Infrastructure as Code, cloud security, and best practices",
}
EDITOR_PERSONA_DEFAULT = "code reviewer specializing in software engineering best practices"
EDITOR_PROMPT = """You are an expert {persona}.

Analyze the following {name} code and identify:

1. **Performance Issues**: Inefficient operations, bottlenecks, optimization opportunities
2. **Semantic Issues**: Logic errors, incorrect implementations, anti-patterns
3. **Architecture Issues**: Design problems, scalability concerns, maintainability
4. **Security Issues**: Vulnerabilities, misconfigurations, exposed secrets
5. **Context-Aware Problems**: Issues that require understanding the intent and context
6. **Complex Patterns**: Problems that go beyond simple regex pattern matching

CODE TO ANALYZE:
```{lower_name}
{content}
```

Return your analysis in the following JSON format:
{
  "issues": [
    {
      "severity": "critical" | "high" | "medium" | "low" | "info",
      "category": "Performance" | "Data Flow" | "Architecture" | "Logic" | "Best Practice" | "Security",
      "message": "Brief description of the issue",
      "lineNumber": 42,
      "suggestion": "How to fix the issue",
      "reasoning": "Why this is an issue and what the impact is"
    }
  ],
  "strengths": ["Things done well in the code"],
  "recommendations": ["Additional suggestions for improvement"],
  "refactoredCode": "The complete refactored version of the code with ALL identified issues fixed."
}

IMPORTANT:
- Focus on complex issues that require semantic understanding
- Provide actionable, specific suggestions
- Include line numbers when possible
- The refactoredCode field MUST contain the complete refactored code that fixes ALL issues you identified.
- Return ONLY valid JSON, no markdown code blocks or other text"""
BATCH_HEAD = """You are an expert code reviewer analyzing multiple files from a code repository.
Analyze each file and identify issues, strengths, and recommendations.

FILES TO REVIEW:
"""
BATCH_FILE = """
=== FILE {index}: {path} ({language}) ===
```{language}
{content}
```
{changes}
"""
BATCH_CHANGES = "\nCHANGED LINES (from git diff):\n"
BATCH_TAIL = """

For each file, identify:
1. **Performance Issues**: Inefficient operations, bottlenecks
2. **Security Issues**: Vulnerabilities, misconfigurations, exposed secrets
3. **Code Quality Issues**: Anti-patterns, maintainability problems
4. **Best Practice Violations**: Deviations from industry standards
5. **Logic Issues**: Bugs, incorrect implementations

Return your analysis as a JSON array with one object per file:
{
  "files": [
    {
      "path": "path/to/file.py",
      "issues": [
        {
          "severity": "critical" | "high" | "medium" | "low" | "info",
          "category": "Performance" | "Security" | "Code Quality" | "Best Practice" | "Logic",
          "message": "Brief description",
          "lineNumber": 42,
          "suggestion": "How to fix",
          "reasoning": "Why this matters"
        }
      ],
      "strengths": ["Good practices observed"],
      "recommendations": ["Improvement suggestions"],
      "score": 85
    }
  ],
  "crossFileIssues": [
    {
      "severity": "medium",
      "category": "Architecture",
      "message": "Issue spanning multiple files",
      "affectedFiles": ["file1.py", "file2.py"],
      "suggestion": "How to address"
    }
  ],
  "overallRecommendations": ["Repository-wide suggestions"]
}

IMPORTANT:
- Focus on actionable, specific feedback
- Include line numbers when possible
- Consider cross-file dependencies and patterns
- Return ONLY valid JSON, no markdown blocks"""


def _filled(template: str, **values: Column) -> Column:
    """Concatenate the template with its {names} replaced; other braces stay."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=(-1, ""))
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def render_prompts(files: DataFrame, analysis_type: str = "review") -> DataFrame:
    """One prompt per file for an analysis type: a narrow projection, no shuffle."""
    prompt = _filled(
        REVIEW_PROMPT,
        persona=lookup(F.lower("language"), REVIEW_PERSONA, REVIEW_PERSONA_DEFAULT),
        TYPE=F.lit(analysis_type.upper()), focus=F.lit(FOCUS[analysis_type]),
        path=F.col("path"), language=F.col("language"), content=F.col("content"),
    )
    return files.withColumn("prompt", prompt).drop("content")


def render_editor_prompts(files: DataFrame) -> DataFrame:
    """One prompt per file, as editors ask for it."""
    name = lookup(F.lower("language"), LANGUAGE_NAMES, F.col("language"))
    prompt = _filled(
        EDITOR_PROMPT,
        persona=lookup(F.lower("language"), EDITOR_PERSONA, EDITOR_PERSONA_DEFAULT),
        name=name, lower_name=F.lower(name), content=F.col("content"),
    )
    return files.withColumn("prompt", prompt).drop("content")


def render_batch_prompts(files: DataFrame) -> DataFrame:
    """Batch prompt per run as ordered segments (``seq`` 0, one per file, the tail).

    The prompt of a run is the concatenation of its segments by ``seq``.  A run of any size stays
    distributed, because no row holds the texts of a whole run.
    """
    diff = F.col("diff") if "diff" in files.columns else F.lit(None).cast("string")
    language = F.when(F.coalesce("language", F.lit("")) != "", F.col("language")).otherwise(
        language_by_extension(F.col("path")))
    changes = F.when(F.coalesce(diff, F.lit("")) != "", F.concat(F.lit(BATCH_CHANGES), diff)).otherwise("")
    # Ranks come from the keys alone; the texts join by (run, file) afterwards.
    order = numbered(files.select("run_id", "file_no"), ["run_id"], "file_no", "index")
    texts = files.join(order, ["run_id", "file_no"])
    gap = F.when(F.col("index") > 1, "\n\n").otherwise("")
    body = _filled(BATCH_FILE, index=F.col("index").cast("string"), path=F.col("path"), language=language,
                   content=F.col("content"), changes=changes)
    runs = files.groupBy("run_id").agg(F.count("*").alias("n"))
    head = runs.select("run_id", F.lit(0).cast("long").alias("seq"), F.lit(BATCH_HEAD).alias("segment"))
    tail = runs.select("run_id", (F.col("n") + 1).alias("seq"), F.lit(BATCH_TAIL).alias("segment"))
    return head.unionByName(texts.select("run_id", F.col("index").alias("seq"), F.concat(gap, body).alias("segment"))).unionByName(tail)
