"""The rules that ``init`` writes, in both forms."""

RULES = """\
# Starter rules.  Delete what you do not need.

rule NO_DEBUGGER {
  lang typescript, javascript
  desc "Breakpoints must not be committed."
  message "Delete the debugger statement."
  match debugger
}

rule NO_CONSOLE (warning) {
  lang typescript, javascript
  desc "Console calls bypass the project's logger."
  message "Call the logger instead."
  sequence { "console" "." any ["("] any * }
}

rule NO_LOOSE_EQUALITY {
  lang typescript, javascript
  desc "Loose comparison converts its operands."
  message "Compare with === or !==."
  match Token[text in ["==", "!="], class = "symbol"]
}

rule TODO_NEEDS_ISSUE (warning) {
  desc "A TODO comment should name its issue."
  message "Add the issue, as in TODO(ABC-123)."
  match @comment & /TODO/ & ^/TODO.*(#[0-9]+|[A-Z]+-[0-9]+)/
}

rule NO_SNAKE_CASE_LOCALS (warning) {
  lang typescript, javascript
  desc "Names are written in camelCase."
  message "Rename it."
  match @ident & /^[a-z][a-z0-9]*_[a-z0-9_]*$/
}
"""

YAML = """\
# Starter rules.  Delete what you do not need.
rules:
  - id: NO_DEBUGGER
    severity: error
    description: Breakpoints must not be committed.
    message: Delete the debugger statement.
    applies_to: {languages: [typescript, javascript]}
    match: {text: debugger}
  - id: NO_CONSOLE
    severity: warning
    description: Console calls bypass the project's logger.
    message: Call the logger instead.
    applies_to: {languages: [typescript, javascript]}
    match_sequence:
      steps:
        - attrs: {text: console}
        - attrs: {text: "."}
        - attrs: {}
        - alt: [[{attrs: {text: "("}}]]
        - attrs: {}
          quant: zero_or_more
  - id: NO_LOOSE_EQUALITY
    severity: error
    description: Loose comparison converts its operands.
    message: Compare with === or !==.
    applies_to: {languages: [typescript, javascript]}
    match: {text.any: ["==", "!="], class: symbol}
  - id: TODO_NEEDS_ISSUE
    severity: warning
    description: A TODO comment should name its issue.
    message: Add the issue, as in TODO(ABC-123).
    match: {class: comment, text.regex: TODO, text.not.regex: "TODO.*(#[0-9]+|[A-Z]+-[0-9]+)"}
  - id: NO_SNAKE_CASE_LOCALS
    severity: warning
    description: Names are written in camelCase.
    message: Rename it.
    applies_to: {languages: [typescript, javascript]}
    match: {class: ident, text.regex: "^[a-z][a-z0-9]*_[a-z0-9_]*$"}
"""
