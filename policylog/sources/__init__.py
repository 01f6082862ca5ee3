"""Where facts and policies come from."""
