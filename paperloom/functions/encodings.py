"""Characters at the slots of fonts' encodings, and LaTeX of characters. Runs begin at a slot and go on slot by slot; · stands for none."""

from __future__ import annotations

#: TeX mathematical italic (OML). From 0x3A on only where a font sits in the private area.
OML = {0x00: "ΓΔΘΛΞΠΣΥΦΨΩαβγδϵ", 0x10: "ζηθικλμνξπρστυϕχ", 0x20: "ψωεϑϖϱςφ", 0x3A: ".,</>⋆∂", 0x5B: "♭♮♯⌣⌢ℓ", 0x7B: "ıȷ℘⃗"}
#: TeX symbols (OMS); 0x41 to 0x5A are calligraphic letters.
OMS = {
    0x00: "−⋅×∗÷⋄±∓⊕⊖⊗⊘⊙◯∘∙", 0x10: "≍≡⊆⊇≤≥≼≽∼≈⊂⊃≪≫≺≻", 0x20: "←→↑↓↔↗↘≃⇐⇒⇑⇓⇔↖↙∝", 0x30: "′∞∈∋△▽̸·∀∃¬∅ℜℑ⊤⊥",
    0x5B: "∪∩⊎∧∨", 0x60: "⊢⊣⌊⌋⌈⌉{}⟨⟩|∥", 0x6E: "\\", 0x70: "√·∇∫⊔⊓⊑⊒§†‡",
}
#: TeX extension (OMX): delimiters of several sizes, tops of delimiters that are put together, large operators, wide accents, roots.
OMX = {
    0x00: "()[]⌊⌋⌈⌉{}⟨⟩|∥/\\", 0x10: "()()[]⌊⌋⌈⌉{}⟨⟩", 0x20: "()[]", 0x28: "{}⟨⟩", 0x30: "()[]", 0x38: "{}",
    0x46: "⊔⊔∮∮⊙⊙⊕⊕⊗⊗", 0x50: "∑∏∫⋃⋂⊎⋀⋁∑∏∫⋃⋂⊎⋀⋁", 0x60: "∐∐", 0x62: "̂̂̂̃̃̃", 0x70: "√√√√√",
}
#: Slots of OMX and of the Symbol encoding with pieces of delimiters that mean nothing by themselves.
OMX_PIECES = (*range(0x34, 0x38), *range(0x3A, 0x44), 0x75, 0x76)
SYMBOL_PIECES = (*range(0xE6, 0xF0), *range(0xF3, 0xFF))
#: TeX text (OT1), control slots; the letters of 0x0B to 0x0F and their LaTeX are the same.
OT1 = {0x00: "ΓΔΘΛΞΠΣΥΦΨΩ", 0x10: "ıȷ`´ˇ˘¯˚", 0x19: "ßæœøÆŒØ"}
OT1_LIGATURES = {0x0B: "ff", 0x0C: "fi", 0x0D: "fl", 0x0E: "ffi", 0x0F: "ffl"}
#: Adobe Symbol, also as word processors put it into the private area.
SYMBOL = {
    0x22: "∀·∃··∋··∗··−", 0x40: "≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", 0x5E: "⊥", 0x61: "αβχδεφγηιϕκλμνοπθρστυϖωξψζ", 0x7E: "∼",
    0xA2: "′≤·∞", 0xAB: "↔←↑→↓", 0xB1: "±″≥×∝∂∙÷≠≡≈", 0xC4: "⊗⊕∅∩∪⊃⊇", 0xCC: "⊂⊆∈∉", 0xD1: "∇", 0xD5: "∏√⋅¬∧∨⇔⇐", 0xDE: "⇒", 0xE1: "⟨", 0xE5: "∑", 0xF1: "⟩∫",
}

#: LaTeX of characters wherever they stand.
COMMANDS = r"""
α \alpha  β \beta  γ \gamma  δ \delta  ε \varepsilon  ϵ \epsilon  ζ \zeta  η \eta  θ \theta  ϑ \vartheta  ι \iota  κ \kappa
λ \lambda  μ \mu  µ \mu  ν \nu  ξ \xi  π \pi  ϖ \varpi  ρ \rho  ϱ \varrho  σ \sigma  ς \varsigma  τ \tau  υ \upsilon
φ \varphi  ϕ \phi  χ \chi  ψ \psi  ω \omega
Γ \Gamma  Δ \Delta  ∆ \Delta  Θ \Theta  Λ \Lambda  Ξ \Xi  Π \Pi  Σ \Sigma  Υ \Upsilon  Φ \Phi  Ψ \Psi  Ω \Omega  Ω \Omega
∂ \partial  ∇ \nabla  ∞ \infty  ℓ \ell  ℏ \hbar  ∅ \emptyset  ∀ \forall  ∃ \exists  ∄ \nexists  ¬ \neg
∈ \in  ∉ \notin  ∋ \ni  ⊂ \subset  ⊃ \supset  ⊆ \subseteq  ⊇ \supseteq  ⊊ \subsetneq  ⊋ \supsetneq  ∪ \cup  ∩ \cap  ⊎ \uplus  ∖ \setminus
∧ \wedge  ∨ \vee  ⊕ \oplus  ⊖ \ominus  ⊗ \otimes  ⊘ \oslash  ⊙ \odot  ± \pm  ∓ \mp  × \times  ÷ \div  ⋅ \cdot  · \cdot
∘ \circ  ∙ \bullet  ∗ \ast  ⋆ \star  ∝ \propto  ∼ \sim  ≃ \simeq  ≅ \cong  ≈ \approx  ≡ \equiv  ≠ \neq
≤ \leq  ⩽ \leqslant  ≥ \geq  ⩾ \geqslant  ≪ \ll  ≫ \gg  ≺ \prec  ≻ \succ  ≼ \preceq  ≽ \succeq
⊥ \perp  ⊤ \top  ⊢ \vdash  ⊣ \dashv  ⊨ \models  ← \leftarrow  → \rightarrow  ↑ \uparrow  ↓ \downarrow  ↔ \leftrightarrow
⇐ \Leftarrow  ⇒ \Rightarrow  ⇔ \Leftrightarrow  ↦ \mapsto  ⟶ \longrightarrow  ⟵ \longleftarrow  ⟹ \Longrightarrow
∑ \sum  ∏ \prod  ∐ \coprod  ∫ \int  ∬ \iint  ∭ \iiint  ∮ \oint  ⋃ \bigcup  ⋂ \bigcap  ⨁ \bigoplus  ⨂ \bigotimes
⋁ \bigvee  ⋀ \bigwedge  ⨄ \biguplus  ⨆ \bigsqcup  √ \sqrt  ∥ \|  ⟨ \langle  ⟩ \rangle  ⌊ \lfloor  ⌋ \rfloor  ⌈ \lceil  ⌉ \rceil
′ ^\prime  ″ ^{\prime\prime}  − -  – -
ℝ \mathbb{R}  ℂ \mathbb{C}  ℕ \mathbb{N}  ℤ \mathbb{Z}  ℚ \mathbb{Q}  𝔼 \mathbb{E}  ℙ \mathbb{P}  𝕀 \mathbb{I}  ℜ \Re  ℑ \Im  ℘ \wp  ℵ \aleph
\uf8eb (  \uf8ed )  \uf8f6 )  \uf8f8 )  \uf8ee [  \uf8f0 ]  \uf8f9 ]  \uf8fb ]  \uf8f1 \{  \uf8f3 \}  \uf8fc \}  \uf8fe \}
"""
#: LaTeX of characters at slots only, for all encodings and then where one of them differs.
SLOT_COMMANDS = r"""
⋄ \diamond  ◯ \bigcirc  ≍ \asymp  ↗ \nearrow  ↘ \searrow  ⇑ \Uparrow  ⇓ \Downarrow  ↖ \nwarrow  ↙ \swarrow
△ \triangle  ▽ \bigtriangledown  ̸ \not  { \{  } \}  ⊔ \sqcup  ⊓ \sqcap  ⊑ \sqsubseteq  ⊒ \sqsupseteq  § \S  † \dagger  ‡ \ddagger
♭ \flat  ♮ \natural  ♯ \sharp  ⌣ \smile  ⌢ \frown  ı \imath  ȷ \jmath  ⃗ \vec
"""
OMS_COMMANDS = r"\ \setminus"
OMX_COMMANDS = r"\ \backslash  ⊔ \bigsqcup  ⊙ \bigodot  ⊕ \bigoplus  ⊗ \bigotimes  ⊎ \biguplus  ̂ \widehat  ̃ \widetilde"
OT1_COMMANDS = r"´ '  ˇ \check  ˘ \breve  ¯ \bar  ˚ \mathring  ß ss  æ ae  œ oe  ø o  Æ AE  Œ OE  Ø O"
SYMBOL_COMMANDS = r"Α A  Β B  Χ X  Ε E  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Ζ Z  ο o  φ \phi  ϕ \varphi"
LARGE = "∑∏∐∫∬∭∮⋃⋂⨁⨂⋁⋀⨄⨆"
ACCENTS = "̀́̂̃̄̅̇̈⃗ˆ˜¯˙¨"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
DOUBLE_STRUCK = dict(zip("CHNPQRZ", "ℂℍℕℙℚℝℤ", strict=True))
#: Fonts by encoding, as patterns of their names in capitals.
FONTS = {
    "omx": "^(?:CMEX|LMEX|LMMATHEXTENSION|EUEX|MTEX|TXEX|PXEX|STIXSIZE|MATHDESIGN.*EX)",
    "oms": "^(?:CMSY|CMBSY|LMSY|LMMATHSYMBOLS|MTSYN|TXSY|PXSY)",
    "oml": "^(?:CMMI|LMMI|LMMATHITALIC|MTMI|EURM|EUBM|TXMI|PXMI)",
    "ot1": "^(?:CMR|CMBX|CMTI|CMSL|CMSS|CMTT)[0-9]",
    "symbol": r"^(?:SYMBOL|SYMBOLMT|STANDARD\s*SYMBOLS\s*L|PSYMBOL)$",
}
