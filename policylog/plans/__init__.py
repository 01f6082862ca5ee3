"""Rule texts as plans: tokens, syntax, checks, strata and canonical form."""
