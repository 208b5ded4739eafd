"""Column -> Column helpers; nothing here touches a DataFrame."""
