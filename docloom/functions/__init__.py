"""Column functions: text in, column out; nothing here touches a DataFrame."""
