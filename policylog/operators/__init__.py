"""Physical operators: rules as DataFrame joins, and fixpoints over them."""
