"""LaTeX commands that have a sign of their own."""

#: Commands and what they stand for (fixed values).
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ",
    "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ",
    "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ",
    "Omega": "Ω", "forall": "∀", "exists": "∃", "neg": "¬", "lnot": "¬", "land": "∧", "wedge": "∧", "lor": "∨",
    "vee": "∨", "rightarrow": "→", "to": "→", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftrightarrow": "⇔",
    "top": "⊤", "bot": "⊥", "vdash": "⊢", "models": "⊨", "equiv": "≡", "sum": "∑", "prod": "∏", "int": "∫",
    "infty": "∞", "cdot": "·", "times": "×", "div": "÷", "pm": "±", "mp": "∓", "ast": "*", "leq": "≤", "geq": "≥",
    "neq": "≠", "approx": "≈", "propto": "∝", "sim": "∼", "leftarrow": "←",
}
#: Commands that put a mark on their argument.
ACCENTS = {"vec": "\u20d7", "hat": "\u0302", "tilde": "\u0303", "bar": "\u0305"}
