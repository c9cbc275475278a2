from loanloom_oracle.statements import statement, statements

__all__ = ["statement", "statements"]
