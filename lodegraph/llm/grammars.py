"""The grammars of the languages that `syntax` judges: regular expressions over tokens and rules, without left recursion.

Precedence plays no part in validity, so binary operators are flat. Where a language decides by lookahead or by declared names,
the alternatives run side by side. NEVER is a token that doesn't occur.
"""

from __future__ import annotations

# ---------------------------------------------------------------- JavaScript and TypeScript

JS_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this "
    "throw try typeof var void while with null true false enum yield"
).split()
JS_SOFT = (
    "async await of get set static from as let type interface declare namespace module abstract readonly keyof infer is asserts satisfies public private protected override "
    "implements unique accessor using out require global"
).split()

_JS_COMMON = """
File: Stmt*
Stmt: Block | ';' | VarStmt End | ExprNB End | If | For | While | 'do' Stmt 'while' '(' Expr ')' (';' | ASI)? | 'continue' Id? End | 'break' Id? End | 'return' Expr? End | 'with' '(' Expr ')' Stmt
  | Id ':' Stmt | 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}' | 'throw' Expr End | Try | 'debugger' End | FnDecl | ClassDecl | Import | Export | TsStmt
End: ';' | ASI
Block: '{' Stmt* '}'
VarStmt: ('var' | 'const' | 'let') VarDecl % ','
VarDecl: Binding '!'? Ann? ('=' Assign)?
If: 'if' '(' Expr ')' Stmt ('else' Stmt)?
While: 'while' '(' Expr ')' Stmt
For: 'for' 'await'? '(' ForHead ')' Stmt
ForHead: (VarStmt | Expr)? ';' Expr? ';' Expr? | (('var' | 'const' | 'let')? Binding | Primary Postfix*) ('in' Expr | 'of' Assign)
Try: 'try' Block ('catch' ('(' Binding Ann? ')')? Block ('finally' Block)? | 'finally' Block)
FnDecl: 'async'? 'function' '*'? Id TParams? '(' Params ')' Ann? (Block | TsEnd)
FnExpr: 'async'? 'function' '*'? Id? TParams? '(' Params ')' Ann? Block
Params: (Param % ',' ','?)?
Param: Decorator* Mods* ('...'? Binding | 'this') '?'? Ann? ('=' Assign)?
Binding: Id | '[' BElem? (',' BElem?)* ']' | '{' (BindProp % ',' ','?)? '}'
BElem: '...'? Binding ('=' Assign)?
BindProp: '...' Binding | Id ('=' Assign)? | PropName ':' Binding ('=' Assign)?
Decorator: '@' Primary Postfix*
ClassDecl: Decorator* 'abstract'? 'class' Id? ClassTail
ClassTail: TParams? ('extends' Primary Postfix* TArgs?)? Impl? '{' Member* '}'
Member: ';' | 'static' Block | Decorator* Mods* ('get' | 'set' | 'async' | '*' | 'accessor')* (PropName | HASH) ('?' | '!')? (TParams? '(' Params ')' Ann? (Block | TsEnd) | Ann? ('=' Assign)? End) | IndexSig
PropName: Name | STR | NUM | '[' Assign ']'
Import: 'import' (STR | ImportClause 'from' STR) ('with' Obj)? End
ImportClause: TypeOnly? (Id (',' ('*' 'as' Id | Named))? | '*' 'as' Id | Named)
Named: '{' (NamedItem % ',' ','?)? '}'
NamedItem: TypeOnly? (Name | STR) ('as' (Name | STR))?
Export: 'export' (('*' ('as' (Name | STR))? | TypeOnly? Named) 'from' STR End | TypeOnly? Named End | 'default' (FnExpr | FnDecl | ClassDecl | ExprNB End | TsDecl) | VarStmt End | FnDecl | ClassDecl | TsDecl)
Expr: Assign % ','
Assign: Prefix+ Primary Postfix* BinTail | Primary Postfix* (AssignOp Assign | BinTail) | Arrow | 'yield' '*'? Assign? | GenericArrow
ExprNB: (Prefix+ Primary Postfix* BinTail | PrimaryNB Postfix* (AssignOp Assign | BinTail) | Arrow | 'yield' '*'? Assign? | Pattern '=' Assign) (',' Assign)*
Pattern: NEVER
BinTail: (BinOp Unary | TsAs)* ('?' Assign ':' Assign)?
Unary: Prefix* Primary Postfix* | Arrow
Prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | TsCast
BinOp: '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Primary: PrimaryNB | Obj | FnExpr | Decorator* 'class' Id? ClassTail
PrimaryNB: Id | NUM | STR | RE | Template | 'this' | 'super' | 'null' | 'true' | 'false' | Array | '(' Expr ')' | 'new' ('.' Name | Prim2 | 'new' Prim2) | 'import' ('(' Expr ','? ')' | '.' Name) | HASH 'in' Unary | Jsx
Prim2: Id | 'this' | '(' Expr ')' | FnExpr | 'class' Id? ClassTail | Template | 'import' '.' Name
Postfix: '.' (Name | HASH) | '[' Expr ']' | Args | '?.' (Name | HASH | '[' Expr ']' | Args | TArgs Args) | Template | '++' | '--' | TsPost
Args: '(' (('...'? Assign) % ',' ','?)? ')'
Array: '[' (','* ('...'? Assign) (','+ ('...'? Assign))* ','* | ','*) ']'
Obj: '{' (Prop % ',' ','?)? '}'
Prop: '...' Assign | Id ('=' Assign)? | PropName ':' Assign | ('get' | 'set' | 'async' | '*')* PropName TParams? '(' Params ')' Ann? Block
Arrow: 'async'? (Id | '(' Params ')' Ann?) '=>' (Assign | Block)
Template: '`' ('${' Expr '}$')* '`$'
"""
_JS_ONLY = """
TsStmt: NEVER
TsDecl: NEVER
TsEnd: NEVER
Ann: NEVER
TParams: NEVER
TArgs: NEVER
Mods: 'static'
Impl: NEVER
IndexSig: NEVER
TypeOnly: NEVER
TsAs: NEVER
TsCast: NEVER
TsPost: NEVER
GenericArrow: NEVER
"""
_TS_ONLY = """
TsStmt: TsDecl | 'import' 'type'? Id '=' (('require' '(' STR ')') | Id ('.' Name)*) End | 'export' '=' Expr End | 'export' 'as' 'namespace' Id End
TsDecl: 'declare'? ('interface' Id TParams? ('extends' TRef % ',')? TObj | 'type' Id TParams? '=' Type End | 'const'? 'enum' Id '{' ((PropName ('=' Assign)?) % ',' ','?)? '}' | ('namespace' | 'module') (Id ('.' Id)* | STR) (Block | End))
  | 'declare' ('global' Block | VarStmt End | FnDecl | ClassDecl)
TsEnd: ';' | ASI
Ann: ':' (Type | 'asserts' Id ('is' Type)? | (Id | 'this') 'is' Type)
TParams: '<' ((('const' | 'in' | 'out')* Id ('extends' Type)? ('=' Type)?) % ',') ','? '>'
TArgs: '<' (Type % ',') '>'
Mods: 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
Impl: 'implements' TRef % ','
IndexSig: Mods* '[' Id ':' Type ']' Ann? End
TypeOnly: 'type'
TsAs: ('as' | 'satisfies') ('const' | Type)
TsCast: NEVER
TsPost: '!' | TArgs
GenericArrow: 'async'? TParams '(' Params ')' Ann? '=>' (Assign | Block)
Type: FnType | TUnion ('extends' TUnion '?' Type ':' Type)?
FnType: 'abstract'? 'new'? TParams? '(' Params ')' '=>' (Type | 'asserts' Id ('is' Type)? | (Id | 'this') 'is' Type)
TUnion: ('|' | '&')? TOp (('|' | '&') TOp)*
TOp: ('keyof' | 'unique' | 'readonly' | 'infer')* TPrim ('[' Type? ']')*
TRef: Id ('.' Name)* TArgs?
TPrim: TRef | STR | NUM | '-' NUM | 'true' | 'false' | 'null' | 'void' | 'this' | '(' Type ')' | TObj | '[' ((('...')? (Id '?'? ':')? Type '?'?) % ',' ','?)? ']' | 'typeof' ('import' '(' STR ')' | Id) ('.' Name)* TArgs? | TTemplate | 'import' '(' STR ')' ('.' Name)* TArgs?
TTemplate: '`' ('${' Type '}$')* '`$'
TObj: '{' (TMember (';' | ',' | ASI))* TMember? '}'
TMember: ('readonly' | '+' | '-')* ('get' | 'set')? PropName '?'? (TParams? '(' Params ')' Ann? | Ann?) | 'new'? TParams? '(' Params ')' Ann? | ('readonly' | '+' | '-')* '[' Id (':' | 'in') Type ('as' Type)? ']' ('?' | '+' '?' | '-' '?')? Ann?
"""
_JSX = """
Jsx: 'j<' JTag
JTag: 'j>' Kids | JName TArgs? JAttr* ('j/>' | 'j>' Kids)
JAttr: JName ('=' (STR | 'j{' Assign '}$' | 'j<' JTag))? | 'j{' '...' Assign '}$'
JName: JID
Kids: (JTEXT | 'j{' ('...'? Expr)? '}$' | 'j<' JTag)* 'j</' JName? 'j>'
"""
JS = _JS_COMMON + _JS_ONLY + "Jsx: NEVER\n"
TS = _JS_COMMON + _TS_ONLY + "Jsx: NEVER\n"
TSX = _JS_COMMON + _TS_ONLY + _JSX

# ---------------------------------------------------------------- Python

PY_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PY_SOFT = "match case type".split()

PYTHON = """
File: (Stmt | NL)*
Stmt: Simple % ';' ';'? NL | Compound
Suite: Simple % ';' ';'? NL | NL+ INDENT Stmt (Stmt | NL)* DEDENT
Simple: (Targets '=')+ (Yield | StarExprs) | StarExprs | Yield | AugTarget AugOp (Yield | Exprs) | AnnTarget ':' Expr ('=' (Yield | StarExprs))? | 'return' StarExprs? | 'raise' (Expr ('from' Expr)?)? | 'global' Id % ',' | 'nonlocal' Id % ',' | 'pass' | 'break' | 'continue'
  | 'del' TargetList | 'assert' Expr (',' Expr)? | Import | 'type' Id TypeParams? '=' Expr
Import: 'import' (Dotted ('as' Id)?) % ',' | 'from' ('.' | '...')* Dotted 'import' Names | 'from' ('.' | '...')+ 'import' Names
Names: '*' | (Id ('as' Id)?) % ',' | '(' (Id ('as' Id)?) % ',' ','? ')'
Dotted: Id ('.' Id)*
Targets: TargetItem % ',' ','?
TargetList: TargetItem % ',' ','?
TargetItem: '*'? Target | '(' Targets? ')' | '[' Targets? ']'
Target: Id | Atom Trailer* ('.' Id | '[' Slices ']')
AugTarget: Target | '(' Target ')'
AnnTarget: Target | '(' Target ')'
AugOp: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Compound: 'if' Named ':' Suite ('elif' Named ':' Suite)* Else? | 'while' Named ':' Suite Else? | 'async'? 'for' Targets 'in' StarExprs ':' Suite Else? | Try | 'async'? 'with' WithItems ':' Suite | Decorated | Match
Else: 'else' ':' Suite
Try: 'try' ':' Suite (('except' ('*'? Expr ('as' Id)?)? ':' Suite)+ Else? ('finally' ':' Suite)? | 'finally' ':' Suite)
WithItems: WithItem % ',' | '(' WithItem % ',' ','? ')'
WithItem: Expr ('as' TargetItem)?
Decorated: ('@' Named NL+)* (Class | 'async'? Def)
Class: 'class' Id TypeParams? ('(' Arglist? ')')? ':' Suite
Def: 'def' Id TypeParams? '(' Params? ')' ('->' Exprs)? ':' Suite
TypeParams: '[' (('*' | '**')? Id (':' Expr)? ('=' '*'? Expr)?) % ',' ','? ']'
Params: Param % ',' ','?
Param: Id (':' StarExpr)? ('=' Expr)? | '*' (Id (':' StarExpr)?)? | '**' Id (':' Expr)? | '/'
LParams: LParam % ',' ','?
LParam: Id ('=' Expr)? | '*' Id? | '**' Id | '/'
Match: 'match' StarExprs ':' NL+ INDENT ('case' Patterns ('if' Named)? ':' Suite NL*)+ DEDENT
Patterns: PItem % ',' ','?
PItem: '*' Id | POr ('as' Id)?
POr: PPrim % '|'
PPrim: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted ('(' ((Id '=')? PItem) % ',' ','? ')' | '(' ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{' ((('-'? NUM | STR+ | Dotted | 'None' | 'True' | 'False') ':' PItem | '**' Id) % ',' ','?)? '}'
Yield: 'yield' ('from' Expr | StarExprs)?
StarExprs: StarExpr % ',' ','?
StarExpr: '*' Flat | Named
Exprs: Expr % ',' ','?
Named: (Id ':=')? Expr
Expr: Flat ('if' Flat 'else' Expr)? | Lambda
Lambda: 'lambda' LParams? ':' Expr
Flat: Unary (BinOp Unary)*
BinOp: 'or' | 'and' | 'in' | 'not' 'in' | 'is' 'not'? | '<' | '>' | '<=' | '>=' | '==' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '@' | '/' | '//' | '%' | '**'
Unary: ('not' | '+' | '-' | '~')* 'await'? Atom Trailer*
Trailer: '.' Id | '[' Slices ']' | '(' Arglist? ')'
Slices: Slice % ',' ','?
Slice: StarExpr | Expr? ':' Expr? (':' Expr?)?
Arglist: Arg % ',' ','?
Arg: Named Comp? | Id '=' Expr | '*' Expr | '**' Expr
Comp: ('async'? 'for' Targets 'in' Flat ('if' CompIf)*)+
CompIf: Flat | Lambda | Id ':=' Expr
Atom: Id | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (Yield | StarExpr Comp | StarExprs)? ')' | '[' (StarExpr Comp | StarExprs)? ']' | '{' (DictItem (Comp | (',' DictItem)* ','?) | StarExpr Comp | StarExprs)? '}'
DictItem: Expr ':' Expr | '**' Flat
"""

# ---------------------------------------------------------------- Go

GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()

GO = """
File: 'package' ID ';' ('import' (ImportSpec | '(' (ImportSpec (';' ImportSpec)* ';'?)? ')') ';')* (Top ';')*
ImportSpec: ('.' | ID)? STR
Top: Decl | 'func' ('(' Params ')')? ID TParams? Signature Block?
Decl: 'const' Group1 | 'type' Group2 | 'var' Group3
Group1: ConstSpec | '(' (ConstSpec (';' ConstSpec)* ';'?)? ')'
Group2: TypeSpec | '(' (TypeSpec (';' TypeSpec)* ';'?)? ')'
Group3: VarSpec | '(' (VarSpec (';' VarSpec)* ';'?)? ')'
ConstSpec: ID % ',' (Type? '=' Exprs)?
TypeSpec: ID TParams? '='? Type
VarSpec: ID % ',' (Type ('=' Exprs)? | '=' Exprs)
TParams: '[' (ID % ',' Constraint) % ',' ','? ']'
Constraint: ('~'? Type) % '|'
Signature: '(' Params ')' Result?
Result: Type | '(' Params ')'
Params: ((Param) % ',' ','?)?
Param: ID? '...'? Type | ID
Type: TypeNP | '(' Type ')'
TypeNP: ID ('.' ID)? ('[' Type % ',' ']')? | '*' Type | '[' ('...' | Expr)? ']' Type | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | 'struct' '{' (Field (';' Field)* ';'?)? '}' | 'interface' '{' (IElem (';' IElem)* ';'?)? '}'
Field: (ID % ',' Type | '*'? ID ('.' ID)? ('[' Type % ',' ']')?) STR?
IElem: ID Signature | Constraint
Block: '{' Stmts '}'
Stmts: (Stmt? ';')* Stmt?
Stmt: Decl | SimpleStmt | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For | 'go' Expr | 'defer' Expr | ID ':' Stmt?
SimpleStmt: Exprs (('++' | '--') | AssignOp Exprs | '<-' Expr)? | ID % ',' ':=' Exprs
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If: 'if' (SimpleStmt? ';')? Expr Block ('else' (If | Block))?
Switch: 'switch' (SimpleStmt? ';')? (SimpleStmt)? '{' (('case' (Exprs | Type % ',') | 'default') ':' Stmts)* '}'
Select: 'select' '{' (('case' SimpleStmt | 'default') ':' Stmts)* '}'
For: 'for' (Expr | SimpleStmt? ';' Expr? ';' SimpleStmt? | (Exprs ('=' | ':='))? 'range' Expr)? Block
Exprs: Expr % ','
Expr: Unary (BinOp Unary)*
BinOp: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Primary
Primary: Operand (Post)*
Operand: NUM | STR | CHAR | ID | '(' (Expr | Type) ')' | 'func' Signature Block? | LitType Lit | '[' ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'struct' '{' (Field (';' Field)* ';'?)? '}' | 'interface' '{' '}'
LitType: '[' ('...' | Expr)? ']' Type | 'map' '[' Type ']' Type | 'struct' '{' (Field (';' Field)* ';'?)? '}'
Post: '.' (ID | '(' (Type | 'type') ')') | '[' (Expr | Type % ',' | Expr? ':' Expr? (':' Expr)?) ']' | '(' ((Expr | Type) % ',' '...'? ','?)? ')' | Lit
Lit: '{' (Elem % ',' ','?)? '}'
Elem: (Expr | Lit) (':' (Expr | Lit))?
"""

# ---------------------------------------------------------------- Java

JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native "
    "new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
).split()
JAVA_SOFT = "var record sealed permits yield non when module open".split()

JAVA = """
File: (Annotation* 'package' Qual ';')? ('import' 'static'? Qual ('.' '*')? ';' | ';')* (TypeDecl | ';')*
Qual: Id ('.' Id)*
Annotation: '@' Qual ('(' ((Id '=')? ElemVal) % ',' ')' | '(' ')')?
ElemVal: Expr | Annotation | '{' (ElemVal % ',')? ','? '}'
Mod: Annotation | 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
TypeDecl: Mod* (Class | Interface | Enum | Record | '@' 'interface' Id Body)
Class: 'class' Id TParams? ('extends' Type)? ('implements' Type % ',')? ('permits' Type % ',')? Body
Interface: 'interface' Id TParams? ('extends' Type % ',')? ('permits' Type % ',')? Body
Enum: 'enum' Id ('implements' Type % ',')? '{' (EnumConst % ',')? ','? (';' Member*)? '}'
EnumConst: Annotation* Id Args? Body?
Record: 'record' Id TParams? '(' Params ')' ('implements' Type % ',')? Body
Body: '{' Member* '}'
Member: ';' | 'static'? Block | TypeDecl | Mod* TParams? (Type | 'void') Id '(' Params ')' Dims ('throws' Type % ',')? (Block | ('default' ElemVal)? ';') | Mod* TParams? Id ('(' Params ')' ('throws' Type % ',')?)? Block | Mod* Type VarDecl % ',' ';'
TParams: '<' (Annotation* Id ('extends' Type % '&')?) % ',' '>'
TArgs: '<' ((Annotation* ('?' (('extends' | 'super') Type)? | Type)) % ',')? '>'
Prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
Type: Annotation* (Prim | Id TArgs? ('.' Annotation* Id TArgs?)*) Dims
Dims: (Annotation* '[' ']')*
Params: (Param % ',')?
Param: Mod* Type '...'? (Id '.')? (Id | 'this') Dims
VarDecl: Id Dims ('=' (Expr | ArrayInit))?
ArrayInit: '{' ((Expr | ArrayInit) % ',')? ','? '}'
Block: '{' Stmt* '}'
Stmt: Block | ';' | Mod* Type VarDecl % ',' ';' | TypeDecl | ExprStmt ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | For | 'return' Expr? ';' | 'break' Id? ';' | 'continue' Id? ';' | 'throw' Expr ';' | 'yield' Expr ';'
  | Try | Switch | 'synchronized' '(' Expr ')' Block | 'assert' Expr (':' Expr)? ';' | Id ':' Stmt
For: 'for' '(' ((Mod* Type VarDecl % ',' | Expr % ',')? ';' Expr? ';' (Expr % ',')? | Mod* Type Id ':' Expr) ')' Stmt
Try: 'try' ('(' Resource % ';' ';'? ')')? Block ('catch' '(' Mod* Type % '|' Id ')' Block)* ('finally' Block)?
Resource: Mod* Type Id '=' Expr | Expr
Switch: 'switch' '(' Expr ')' '{' (CaseLabel (':' Stmt* | '->' (Expr ';' | Block | 'throw' Expr ';')))* '}'
CaseLabel: 'case' CaseItem % ',' ('when' Expr)? | 'default'
CaseItem: Expr | 'default' | Pattern
Pattern: Mod* Type Id | Type '(' (Pattern % ',')? ')' Id?
ExprStmt: ('++' | '--') Unary | Primary Post* ('++' | '--' | AssignOp Expr | PostCall) | 'new' Creator Post*
PostCall: Args | '.' TArgs? Id Args
Expr: Lambda | Primary Post* AssignOp Expr | Unary Tail*  ('?' Expr ':' Expr)?
Tail: BinOp Unary | 'instanceof' ('final'? Type Id? | Pattern) | BinOp Lambda
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
BinOp: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
Unary: ('+' | '-' | '++' | '--' | '!' | '~')* (Primary Post* ('++' | '--')* | Cast)
Cast: '(' Type ('&' Type)* ')' (Unary | Lambda)
Lambda: (Id | '(' (Id % ',')? ')' | '(' Params ')') '->' (Expr | Block)
Primary: NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' Args? | 'super' Args? | Id Args? | '(' Expr ')' | 'new' Creator | Prim Dims ('.' 'class' | '::' ('new' | Id)) | 'void' '.' 'class' | Switch | Id TArgs? ('[' ']')* '::' TArgs? (Id | 'new') | Id ('[' ']')+ '.' 'class'
Post: '.' (TArgs? (Id Args? | 'super' Args?) | 'this' | 'class' | 'new' Creator) | '[' Expr ']' | '::' TArgs? (Id | 'new') | ('[' ']')+ '.' 'class'
Creator: Annotation* (Prim | Id TArgs? ('.' Id TArgs?)*) (Args Body? | ('[' Expr ']')+ ('[' ']')* | ('[' ']')+ ArrayInit)
Args: '(' (Expr % ',')? ')'
"""

# ---------------------------------------------------------------- C

C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile "
    "while _Bool _Complex _Atomic _Alignas _Alignof _Generic _Noreturn _Static_assert _Thread_local __attribute__ __asm__ asm __extension__ __inline __inline__ __restrict typeof __typeof__ __const __volatile__ __signed__"
).split()

C = """
File: Ext*
Ext: ';' | Specs (InitDecl % ',')? ';' | Specs Declarator KrDecl* Block | ID Specs (InitDecl % ',')? ';' | ID Specs Declarator Block | ID '(' ArgList? ')' ';'? | Assert | Asm ';' | ID Declarator1 Block | 'extern' STR '{' Ext* '}'
KrDecl: Specs InitDecl % ',' ';'
Assert: '_Static_assert' '(' Expr (',' STR)? ')' ';'
Specs: Q* (Base (Base | Q)* | Struct Q* | ID Q* | Typeof Q*)
Q: 'const' | 'volatile' | 'restrict' | '__restrict' | 'static' | 'extern' | 'typedef' | 'register' | 'auto' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | '_Thread_local' | '_Atomic' | '__extension__' | Attr | '_Alignas' '(' (Expr | TypeName) ')' | '__const' | '__volatile__'
Base: 'int' | 'char' | 'short' | 'long' | 'signed' | 'unsigned' | 'float' | 'double' | 'void' | '_Bool' | '_Complex' | '__signed__'
Typeof: ('typeof' | '__typeof__') '(' (Expr | TypeName) ')'
Attr: '__attribute__' '(' '(' AttrTok* ')' ')'
AttrTok: ID | NUM | STR | ',' | '=' | '(' AttrTok* ')' | 'const' | Base
Struct: ('struct' | 'union') Attr* ID? ('{' Field* '}')? | ('struct' | 'union') Attr* ID | 'enum' Attr* (ID | ID? '{' (Enumerator % ',' ','?) '}')
Field: Specs ((FieldDecl) % ',')? ';' | ';' | Assert
FieldDecl: Declarator (':' Expr1)? Attr* | ':' Expr1
Enumerator: ID Attr* ('=' Expr1)?
InitDecl: Declarator Asm? Attr* ('=' Init)?
Declarator: Ptr* Attr* Declarator1
Ptr: '*' Q*
Declarator1: (ID | '(' Attr* Declarator ')') DSuffix*
DSuffix: '[' ('static' | Q)* ('*' | Expr1)? ']' | '(' ParamList? ')' Attr*
ParamList: Param (',' Param)* (',' '...')?
Param: ID? Specs (Declarator | AbsDecl)? Attr*
AbsDecl: Ptr+ Abs1? | Abs1
Abs1: ('(' AbsDecl ')' | '[' ('static' | Q)* ('*' | Expr1)? ']' | '(' ParamList? ')') ('[' Expr1? ']' | '(' ParamList? ')')*
TypeName: Specs AbsDecl?
Init: Expr1 | '{' (InitItem % ',')? ','? '}'
InitItem: (('[' Expr1 ('...' Expr1)? ']' | '.' ID)+ '=' | ID ':')? Init
Block: '{' (Stmt | Decl)* '}'
Decl: Specs (InitDecl % ',')? ';' | Assert
Stmt: Block | ';' | Expr ';' | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' (Expr? ';' | Decl) Expr? ';' Expr? ')' Stmt | 'return' Expr? ';' | 'break' ';' | 'continue' ';' | 'goto' '*'? ID ';'
  | 'switch' '(' Expr ')' Stmt | 'case' Expr1 ('...' Expr1)? ':' (Stmt | Decl)? | 'default' ':' (Stmt | Decl)? | ID ':' Attr* (Stmt | Decl)? | Asm ';' | ID '(' ArgList? ')' Block
Asm: ('asm' | '__asm__') ('volatile' | '__volatile__' | 'goto' | 'inline')* '(' AsmTok* ')'
AsmTok: STR | ID | ':' | ',' | '[' | ']' | '(' Expr ')' | '::'
Expr: Expr1 % ','
Expr1: Prefix* Primary Post* (AssignOp Expr1 | Tail)
Tail: (BinOp Unary)* ('?' Expr? ':' Expr1)?
Unary: Prefix* Primary Post*
Prefix: '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | '__extension__' | '(' TypeName ')' | 'sizeof' | '_Alignof'
BinOp: '+' | '-' | '*' | '/' | '%' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||'
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>>=' | '&=' | '|=' | '^='
Primary: ID | NUM | CHAR | (STR | ID STR)+ ID? | '(' Expr ')' | '(' Block ')' | '(' TypeName ')' '{' (InitItem % ',')? ','? '}' | ('sizeof' | '_Alignof') '(' TypeName ')' | '_Generic' '(' Expr1 (',' (TypeName | 'default') ':' Expr1)+ ')'
Post: '[' Expr ']' | '(' ArgList? ')' | ('.' | '->') ID | '++' | '--'
ArgList: (Expr1 | TypeName) % ','
"""

# ---------------------------------------------------------------- Rust

RUST_KEYWORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()
RUST_SOFT = "union auto default raw".split()

RUST = """
File: ('#' '!' '[' TT* ']')* Item*
Attr: '#' '[' TT* ']'
Inner: '#' '!' '[' TT* ']'
TT: '(' TT* ')' | '[' TT* ']' | '{' TT* '}' | LEAF
Item: Attr* (Vis? ItemKind | MacroItem)
Vis: 'pub' ('(' ('in' Path | 'crate' | 'self' | 'super') ')')?
ItemKind: 'use' UseTree ';' | 'mod' Id (';' | '{' Inner* Item* '}') | Fn | 'type' Id Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' | Struct | 'enum' Id Generics? Where? '{' (Variant % ',' ','?)? '}' | 'union' Id Generics? Where? '{' Fields '}'
  | 'const' (Id | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? Id ':' Type ('=' Expr)? ';' | 'unsafe'? 'auto'? 'trait' Id Generics? (':' Bounds?)? Where? '{' Inner* Item* '}' | 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' Inner* Item* '}'
  | 'unsafe'? 'extern' STR? '{' Inner* Item* '}' | 'extern' 'crate' (Id | 'self') ('as' (Id | '_'))? ';'
MacroItem: Path '!' Id? ('(' TT* ')' ';' | '[' TT* ']' ';' | '{' TT* '}' ';'?)
UseTree: ('::'? (UPath '::')?)? ('*' | '{' (UseTree % ',' ','?)? '}') | '::'? UPath ('as' (Id | '_'))?
UPath: PSeg0 ('::' PSeg0)*
PSeg0: Id | 'self' | 'super' | 'crate' | 'Self'
Fn: ('default' | 'const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' Id Generics? '(' (FnParam % ',' ','?)? ')' ('->' Type)? Where? (Block | ';')
FnParam: Attr* (('&' LT?)? 'mut'? 'self' (':' Type)? | Pat ':' ('...' | Type) | '...')
Struct: 'struct' Id Generics? (Where? ('{' Fields '}' | ';') | '(' (TField % ',' ','?)? ')' Where? ';')
Fields: ((Attr* Vis? Id ':' Type) % ',' ','?)?
TField: Attr* Vis? Type
Variant: Attr* Vis? Id ('{' Fields '}' | '(' (TField % ',' ','?)? ')')? ('=' Expr)?
Generics: '<' (GParam % ',' ','?)? '>'
GParam: Attr* (LT (':' LT % '+')? | Id (':' Bounds?)? ('=' Type)? | 'const' Id ':' Type ('=' (Block | '-'? NUM | Id))?)
Where: 'where' (WherePred % ',' ','?)?
WherePred: LT ':' LT % '+' | ForLt? Type ':' Bounds?
ForLt: 'for' '<' (LT % ',')? '>'
Bounds: Bound % '+' '+'?
Bound: LT | '?'? ForLt? TPath | '(' '?'? ForLt? TPath ')' | '~' 'const' TPath
TPath: '::'? TSeg ('::' TSeg)*
TSeg: (Id | 'self' | 'super' | 'crate' | 'Self') ('::'? GArgs | '(' (Type % ',' ','?)? ')' ('->' Type)?)?
GArgs: '<' (GArg % ',' ','?)? '>'
GArg: LT | Type | Id GArgs? '=' Type | Id ':' Bounds | '-'? NUM | STR | Block | 'true' | 'false'
Type: TPath | '(' (Type % ',' ','?)? ')' | '&' LT? 'mut'? Type | '&&' LT? 'mut'? Type | '*' ('const' | 'mut') Type | '[' Type (';' Expr)? ']' | '!' | '_' | ForLt? ('unsafe' | 'extern' STR?)* 'fn' '(' (((Id | '_') ':')? Type) % ',' ','? ')' ('->' Type)? | ForLt? ('unsafe' | 'extern' STR?)* 'fn' '(' ')' ('->' Type)?
  | ('impl' | 'dyn') Bounds | '<' Type ('as' TPath)? '>' ('::' TSeg)+ | Path '!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}')
Path: '::'? PSeg0 ('::' PSeg0)*
EPath: ('::'? ESeg | '<' Type ('as' TPath)? '>' '::' ESeg) ('::' ESeg)*
ESeg: PSeg0 | GArgs
Pat: '|'? PatA ('|' PatA)*
PatA: ('&' | '&&')? 'mut'? PatLit (('..=' | '..' | '...') PatLit?)? | ('..=' | '..') PatLit | 'ref'? 'mut'? Id ('@' Pat)? | '_' | '..' | EPath ('(' (Pat % ',' ','?)? ')' | '{' (PatField % ',' ','?)? '}')? | '(' (Pat % ',' ','?)? ')' | '[' (Pat % ',' ','?)? ']' | ('&' | '&&') 'mut'? PatA | Path '!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}')
PatLit: '-'? NUM | STR | CHAR | 'true' | 'false' | EPath
PatField: Attr* ('..' | (Id | NUM) ':' Pat | 'ref'? 'mut'? Id)
Block: '{' Inner* Stmt* Expr? '}'
Stmt: ';' | Item | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' | Attr* BlockExpr | Attr* Expr ';' | Path '!' '{' TT* '}'
BlockExpr: Label? ('loop' Block | 'while' Cond Block | 'for' Pat 'in' Expr Block | Block) | 'unsafe' Block | 'const' Block | 'async' 'move'? Block | If | Match
Label: LT ':'
If: 'if' Cond Block ('else' (Block | If))?
Cond: Expr
Match: 'match' Expr '{' Inner* (Attr* Pat ('if' Expr)? '=>' (Expr ',' | BlockExpr ','?))* (Attr* Pat ('if' Expr)? '=>' Expr)? '}'
Expr: Operand (BinOp Operand)* RangeTail? | ('..' | '..=') (Operand (BinOp Operand)*)? | Closure | Jump
RangeTail: '..' (Operand (BinOp Operand)*)? | '..=' Operand (BinOp Operand)*
Jump: 'return' Expr? | 'break' LT? Expr? | 'continue' LT?
BinOp: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
Operand: Prefix* Primary Post* ('as' Type Post*)* | Prefix* Closure | Prefix+ Jump | Jump | 'let' Pat '=' Operand
Prefix: '-' | '!' | '*' | '&' ('raw'? ('mut' | 'const'))? | '&&' 'mut'?
Closure: 'static'? 'async'? 'move'? ('||' | '|' ((Attr* Pat (':' Type)?) % ',' ','?)? '|') ('->' Type Block | Expr)
Primary: NUM | STR | CHAR | 'true' | 'false' | EPath ('{' (FieldInit % ',' ','?)? ('..' Expr?)? '}' | '{' (FieldInit ',')* '..' Expr? '}')? | Path '!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}') | '(' (Expr % ',' ','?)? ')' | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | BlockExpr
FieldInit: Attr* (Id | NUM) (':' Expr)?
Post: '.' (Id ('::' GArgs)? | NUM | 'await') | '(' (Expr % ',' ','?)? ')' | '[' Expr ']' | '?'
"""

# ---------------------------------------------------------------- bash

BASH_KEYWORDS = "if then else elif fi do done case esac while until for select in function { } ! time [[ ]] coproc".split()

BASH = """
File: NL* List?
List: AndOr ((';' | '&' | NL) NL* AndOr)* (';' | '&' | NL)? NL*
AndOr: Pipe (('&&' | '||') NL* Pipe)*
Pipe: ('!' | 'time')* Command (('|' | '|&') NL* ('!' | 'time')* Command)*
Command: Simple | Compound Redir* | W '(' ')' NL* Compound Redir* | 'function' (W ('(' ')')?) NL* Compound Redir* | 'coproc' Command
Simple: (First | Redir) (Rest | Redir)*
First: W | Sub | Array
Rest: W | Sub | Array | KW
Sub: '$(' NL* List? ')'
Array: 'A(' (Rest | NL | Sub)* ')'
Redir: REDIR (W | Sub | KW) | HEREDOC
Compound: '{' NL* List '}' | '(' NL* List ')' | 'if' NL* List 'then' NL* List ('elif' NL* List 'then' NL* List)* ('else' NL* List)? 'fi' | ('while' | 'until') NL* List Do | 'for' (W | KW) ForTail Do | 'for' ARITH (';' | NL)? NL* (Do | '{' NL* List '}') | 'select' W ForTail Do | Case | ARITH | '[[' (W | Sub | KW | OP | NL)+ ']]'
ForTail: NL* ('in' (Rest)* (';' | NL) NL*)? | ';' NL*
Do: 'do' NL* List 'done'
Case: 'case' (W | Sub | KW)+ NL* 'in' NL* (Clause ';;' NL*)* Clause? 'esac'
Clause: '('? Rest+ ('|' Rest+)* ')' NL* List?
"""
