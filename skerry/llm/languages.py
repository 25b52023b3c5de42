"""Grammars and lexical rules of fifteen languages.

Terminals: ID, NUM, STR, NL (a line end that ends a statement), INDENT and DEDENT, operators by
class (BIN binary; PM + - * & and the like, binary or prefix; NOT prefix; INC both sides; ASG
assignment; LT GT; Q ?; FAT =>; ARROW ->; DC ::; ELL ...), brackets, punctuation and keywords.
Expressions are flat lists of operands and operators: precedence does not matter for validity.
"""

from __future__ import annotations

EXPR = """
E: U | E bop U{tern}{more}
bop: BIN | PM | ASG | LT | GT{bops}
U: P | pre U
pre: PM | NOT | INC{pres}
P: ID | NUM | STR | ( L? ) | P ( L? ) | P [ L? ] | P dot ID | P INC{prim}
dot: .{dots}
L: arg | L , arg | L ,
arg: E{args}
"""


def expr(tern: str = " | E Q E : U", more: str = "", bops: str = "", pres: str = "", prim: str = "", dots: str = "", args: str = "") -> str:
    return EXPR.format(tern=tern, more=more, bops=bops, pres=pres, prim=prim, dots=dots, args=args)


PYTHON = """
file: stmt*
stmt: simples NL | compound | NL
simples: simple | simples ; simple | simples ;
simple: L | L : E | L : E ASG L | return L? | raise | raise E | raise E from E | pass | break | continue | global names | nonlocal names | del L | assert L | yield_stmt | import dotted_as | from from_path import imports | type_alias
type_alias: ID ID ASG E
yield_stmt: yield
names: ID | names , ID
dotted: ID | dotted . ID
dotted_as: dotted | dotted as ID | dotted_as , dotted | dotted_as , dotted as ID
from_path: dotted | dots | dots dotted
dots: . | ELL | dots . | dots ELL
imports: STAR | import_names | ( import_names ) | ( import_names , )
import_names: ID | ID as ID | import_names , ID | import_names , ID as ID
suite: NL INDENT stmt+ DEDENT | simples NL
compound: if E : suite elifs | while E : suite elses? | for TL in L : suite elses? | async for TL in L : suite elses? | with withs : suite | async with withs : suite | try : suite handlers | def_stmt | class ID targs? : suite | class ID targs? ( L? ) : suite | decorator compound | match L : NL INDENT case_stmt+ DEDENT
case_stmt: case L : suite | case L if E : suite
decorator: @ E NL
def_stmt: def ID targs? ( PL? ) ret? : suite | async def ID targs? ( PL? ) ret? : suite
targs: [ L ]
ret: ARROW E
elifs: elif_part* elses?
elif_part: elif E : suite
elses: else : suite
handlers: handler+ elses? final? | final
handler: except : suite | except L : suite | except L as ID : suite | except STAR E : suite | except STAR E as ID : suite
final: finally : suite
withs: with_item | withs , with_item | ( with_list )
with_list: with_as | with_list , with_as | with_list ,
with_as: E as tp
with_item: E | E as tp
TL: tp | TL , tp | TL ,
tp: P | STAR P
E: O | O if O else E | lambda : E | lambda PL : E | O ASGW E
PL: parg | PL , parg | PL ,
parg: arg | STAR | SLASH
O: U | O bop U | O ASG lambda : E | O ASG lambda PL : E
bop: BIN | PM | STAR | SLASH | in | not in | is | is not | and | or | ASG | @ | STST
U: P | pre U
pre: PM | STAR | NOT | not | await | STST | yield | yield from
P: ID | NUM | strs | ELL | ( L? ) | ( yield ) | P ( L? ) | P [ SL ] | [ L? ] | { L? } | P . ID | None | True | False
strs: STR | strs STR
SL: slice | SL , slice | SL ,
slice: E | E : | : E | : | E : E | E : E : E | : : E | : : | E : : | E : : E | : E : | E : E : | : E : E
L: arg | L , arg | L ,
arg: E | E : E | E comp | E : E comp
comp: for TL in O | async for TL in O | comp for TL in O | comp if O
"""

JS_BODY = """
file: body
body: S | S tail
S: | S stmt
tail: simple | if ( L ) tail | if ( L ) stmt else tail | for forhead tail | while ( L ) tail | ID : tail
end: ; | NL
block: {{ body }}
stmt: end | simple end | block | if ( L ) stmt | if ( L ) stmt else stmt | for forhead stmt | for await forhead stmt | while ( L ) stmt | do stmt while ( L ) | do stmt while ( L ) end | switch ( L ) {{ case_part* }} | try block catches | ID : stmt | fn | class_def | export fn | export default fn | export class_def | export default class_def{stmts}
case_part: case L : body | default : body | NL
catches: catch_part | catch_part finally block | finally block
catch_part: catch block | catch ( arg ) block
forhead: ( for_a ; L? ; L? ) | ( for_a in L ) | ( for_a of L ) | ( ; L? ; L? )
for_a: decl | ESL
simple: ESL | return L? | throw L | break ID? | continue ID? | decl | import STR | import import_what from STR | export decl | export default E | export {{ iml }} | export {{ iml }} from STR | export PM from STR | debugger{simples}
import_what: ID | {{ iml }} | PM as ID | ID , {{ iml }} | ID , PM as ID
iml: | imi | iml , imi | iml ,
imi: ID | ID as ID | default as ID | ID as default | ID ID | ID ID as ID
decl: vkw dlist
vkw: var | let | const
dlist: ditem | dlist , ditem
ditem: target | target ASG E
target: pat | pat : T
pat: ID | {{ L? }} | [ L? ]
fn: function star ID? gen? ( L? ) rt block | async function star ID? gen? ( L? ) rt block
star: | PM
rt: {rts}
gen: LT TL GT
class_def: class ID? gen? heritage {{ member* }} | abstract class ID? gen? heritage {{ member* }} | @ P class_def
heritage: | extends P gen? | implements TL | extends P gen? implements TL
member: end | cmods key gen? ( L? ) rt block | cmods key gen? ( L? ) rt end | cmods ID key ( L? ) rt block | cmods key Q? excl? ann? end | cmods key Q? excl? ann? ASG E end | @ P | static block
excl: NOT
ann: : T
cmods: | cmods cmod
cmod: static | async | public | private | protected | readonly | abstract | PM | declare
key: ID | STR | NUM | [ E ] | default | delete | import | in | of | case | if | for | new
ESL: ES | ESL , E
ES: US | ES bop U | ES Q E : U | ES FAT fbody | ES FAT U | TA FAT fbody | TA FAT U | ES bop TA FAT fbody | ES bop TA FAT U | ES as T | ES satisfies T | ES instanceof U | ES in U | ES of U
US: PS | pre U
PS: ID | NUM | STR | ( L? ) | [ L? ] | PS ( L? ) | PS [ L? ] | PS dot ID | PS INC | PS STR | this | super | null | true | false | PS NOT | import ( L ) | PS gen ( L? )
fbody: block
E: U | E bop U | E Q E : U | E FAT fbody | E FAT U | TA FAT fbody | TA FAT U | E bop TA FAT fbody | E bop TA FAT U | E as T | E satisfies T | E instanceof U | E in U
bop: BIN | PM | ASG | LT | GT
U: P | pre U
pre: PM | NOT | INC | ELL | typeof | await | void | delete | new | yield | async
P: ID | NUM | STR | ( L? ) | [ L? ] | {{ props }} | P ( L? ) | P [ L? ] | P dot ID | P INC | P STR | this | super | null | true | false | fn | class_def | P NOT | import ( L ) | P gen ( L? ) | gen ( L? ) rt
dot: . | QDOT
L: arg | L , arg | L , | ,
arg: E | E : T | E : T ASG E | E Q : T | pmod arg
pmod: public | private | protected | readonly
props: | prop | props , prop | props ,
prop: key : E | key | key ASG E | ELL E | key ( L? ) rt block | ID key ( L? ) rt block | async key ( L? ) rt block | PM key ( L? ) rt block | async PM key ( L? ) rt block
TL: T | TL , T | TL ,
T: TU | T BIN TU | T PM TU | T extends TU | T Q T : TU | TU is TU
TU: TP | typeof TU | readonly TU | ID TP | new TU | keyof TU | infer ID
TP: ID | STR | NUM | this | null | true | false | void | TP [ ] | TP [ T ] | TP gen | TP . ID | ( targ_list ) FAT T | ( T ) | {{ tmember* }} | [ TL? ] | PM NUM
targ_list: | targ | targ_list , targ
targ: ID : T | ID Q : T | ELL ID : T
tmember: end | , | mro? [ ID in T ] mq? : T | mro? [ ID in T as T ] mq? : T | key Q? : T | readonly key Q? : T | key Q? ( L? ) rt | ( L? ) rt | [ ID : T ] : T
"""

TYPESCRIPT = JS_BODY.format(
    rts=" | : T",
    stmts=" | interface_def | export interface_def | export default interface_def | enum_def | export enum_def | namespace ID {{ body }} | module ID {{ body }} | declare stmt".replace("{{", "{").replace("}}", "}"),
    simples=" | type ID gen? ASG T | export type ID gen? ASG T | import type import_what from STR",
) + """
mro: readonly | PM readonly
TA: ( L? ) : T | async ( L? ) : T
mq: Q | PM Q
interface_def: interface ID gen? ihead { tmember* }
ihead: | extends TL
enum_def: enum ID { L? NL? } | const enum ID { L? }
"""
JAVASCRIPT = JS_BODY.format(rts="", stmts="", simples="").replace(" | pat : T", "").replace(" | E : T | E : T ASG E | E Q : T | pmod arg", "").replace(" | ES as T | ES satisfies T", "").replace(" | E as T | E satisfies T", "").replace(" | gen ( L? ) rt", "").replace(" | TA FAT fbody | TA FAT U | E bop TA FAT fbody | E bop TA FAT U", "").replace(" | TA FAT fbody | TA FAT U | ES bop TA FAT fbody | ES bop TA FAT U", "").replace(" ann?", "").replace("ann: : T\n", "").replace(" gen?", "").replace(" | PS gen ( L? )", "").replace(" | P gen ( L? )", "").replace(" | PS NOT", "").replace(" | P NOT", "").replace(" | implements TL | extends P implements TL", "")
JAVASCRIPT = "\n".join(r for r in JAVASCRIPT.splitlines() if not r.startswith(("TL: ", "T: ", "TU: ", "TP: ", "targ_list: ", "targ: ", "tmember: ", "gen: ", "pmod: ", "excl: "))).replace(" excl?", "").replace(" | abstract class ID? heritage { member* }", "").replace(" | public | private | protected | readonly | abstract | PM | declare", " | PM")

# C, C++, Java, C#, Dart: a declaration is an operand beside an operand (`int x`, `Map<K, V> y`)
C_BODY = """
file: S
S: | S stmt
block: {{ S }}
stmt: ; | D ; | D block | block | if {iff}( L ) stmt | if {iff}( L ) stmt else stmt | for ( forhead ) stmt | while ( L ) stmt | do stmt while ( L ) ; | switch ( L ) {{ case_part* }} | return L? ; | break ID? ; | continue ID? ; | ID : stmt{stmts}
case_part: case_label+ S
case_label: case D : | default :
forhead: D ; L? ; L? | ; L? ; L?{fors}
D: mod* DL
DL: V | DL , E
V: E | E X
X: E{xs}
mod: {mods}
type: {types}
enum_body: {{ L? }} | {{ L ; S }}
"""
C_TYPES = "int | char | long | short | float | double | void | unsigned | signed | bool"

C = C_BODY.format(
    iff="", stmts=" | goto ID ; | agg ; | mod* agg L ; | typedef agg L ; | D : E ;", fors="", xs="", types=C_TYPES,
    mods="const | static | extern | inline | volatile | register | restrict | typedef | struct | union | enum",
) + """
agg: struct ID? { S } | union ID? { S } | enum ID? { L }
""" + expr(prim=" | type | P type | P STR | { L? } | { inits } | P { L? }", dots=" | ARROW", pres=" | sizeof | type | struct | const", args=" | D2 | ELL", more="") + """
D2: mod+ V | E X
inits: init | inits , init | inits ,
init: . ID ASG E | [ E ] ASG E | . ID ASG { L? }
"""
CPP = C_BODY.format(
    iff="constexpr? ", types=C_TYPES + " | auto | wchar_t | size_t",
    stmts=" | goto ID ; | class_def ; | mod* class_def L ; | access : | try block catch_part+ | throw L? ; | namespace nsname? { S } | using D ; | using namespace nsname ; | template LT TL? GT stmt | D : ilist block | extern STR block | enum class ID { L } ; | enum class ID : type { L } ; | friend D ; | D const block | D override block | D noexcept block | D ASG default ; | D ASG delete ;",
    fors=" | D : L", xs="", mods="const | static | extern | inline | volatile | register | typedef | struct | union | enum | constexpr | virtual | explicit | mutable | typename | friend | thread_local",
) + """
nsname: ID | nsname DC ID
access: public | private | protected
class_def: ckw ID? final? base? { S } | enum ID? { L }
ckw: class | struct | union
base: : base_list
base_list: base_item | base_list , base_item
base_item: access? virtual? E
catch_part: catch ( D ) block | catch ( ELL ) block
ilist: P | ilist , P
TL: targ | TL , targ
targ: typename ID? | class ID? | typename ELL ID | D | typename ID ASG E
""" + expr(
    prim=" | type | P type | P STR | { L? } | P { L? } | DC ID | P LT GT | this | nullptr | true | false | [ L? ] ( L? ) block | [ ASG ] ( L? ) block | [ PM ] ( L? ) block | [ L? ] block | [ PM ] block | [ ASG ] block | [ L? ] ( L? ) ARROW U block | operator_name",
    dots=" | ARROW | DC", pres=" | sizeof | new | delete | delete [ ] | throw | co_await | const", args=" | D2 | ELL", more=" | E GT | E const", bops=" | and | or", tern=" | E Q E : U",
) + """
D2: mod+ V | E X
operator_name: operator BIN | operator PM | operator ASG | operator LT | operator GT | operator ( ) | operator [ ] | operator NOT | operator INC
"""
JAVA = C_BODY.format(
    iff="", types="int | char | long | short | float | double | void | boolean | byte", xs=" | E throws L",
    stmts=" | package L ; | import static? path ; | mod* class_def | mod* init_block | try block catches | try ( res ) block catches? | throw E ; | assert L ; | synchronized ( E ) block | yield E ; | D throws L block | D throws L ;",
    fors=" | D : E", mods="public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | annotation | sealed",
) + """
init_block: static block
path: ID | path . ID | path . PM
annotation: AT ID | AT ID ( L? ) | annotation . ID
class_def: class ID gen? ext* { S } | interface ID gen? ext* { S } | enum ID ext* enum_body | record ID gen? ( L? ) ext* { S } | AT interface ID { S }
ext: extends L | implements L | permits L
gen: LT tpl GT
tpl: tp | tpl , tp
tp: E | E extends E
catches: catch_part+ | catch_part+ finally block | finally block
catch_part: catch ( D ) block
res: D | res ; D | res ;
""" + expr(
    prim=" | type | { L? } | this | super | null | true | false | P { S } | P DC ID | P DC new | P LT GT | P . new P | P . class | P . this | P . super | gen ID | switch ( L ) { arrow_case* }",
    pres=" | new", args=" | D2", more=" | E GT | E ARROW U | E ARROW block | E instanceof D3 | E ELL ID", tern=" | E Q E : U",
) + """
D2: mod+ V | E X
D3: final? U ID?
arrow_case: case L ARROW E ; | case L ARROW block | case L ARROW throw E ; | default ARROW E ; | default ARROW block | default ARROW throw E ;
"""
CSHARP = C_BODY.format(
    iff="", types="int | char | long | short | float | double | void | bool | byte | string | object | decimal | uint | ulong | ushort | sbyte | dynamic", xs=" | E where_c+",
    stmts=" | using D ; | using static L ; | using ( D ) stmt | namespace L block | namespace L ; | mod* class_def | try block catches | throw E? ; | foreach ( D in L ) stmt | await foreach ( D in L ) stmt | lock ( E ) stmt | attr stmt | D : ctor block | D FAT E ; | D FAT throw E ; | D { acc+ } | D { acc+ } ASG E ; | yield return E ; | yield break ; | goto ID ; | unsafe block | checked block | D where_c+ block | D block ;",
    fors="", mods="public | private | protected | internal | static | readonly | abstract | sealed | virtual | override | async | const | extern | partial | volatile | unsafe | event | delegate | ref | out | params | new_mod | required | fixed",
) + """
new_mod: new_m
attr: [ L ]
where_c: where ID : L
ctor: base ( L? ) | this ( L? )
acc: amod* acc_kw ; | amod* acc_kw block | amod* acc_kw FAT E ;
amod: private | protected | internal
acc_kw: get | set | init
class_def: class ID gen? bases? { S } | struct ID gen? bases? { S } | interface ID gen? bases? { S } | enum ID bases? enum_body | record ID gen? bases? { S } | record ID gen? ( L? ) bases? ; | record ID gen? ( L? ) bases? { S }
bases: : L | : L where_c+
gen: LT L GT
catches: catch_part+ | catch_part+ finally block | finally block
catch_part: catch block | catch ( D ) block | catch ( D ) when ( E ) block
""" + expr(
    prim=" | type | { L? } | this | base | null | true | false | P { L? } | P NOT | [ L? ] | P Q . ID | P Q [ L ] | default | typeof ( E ) | nameof ( E ) | switch_tail",
    pres=" | new | await | throw | ref | out | static", args=" | D2 | ID : E | out D3 | ref E | in E", more=" | E GT | E FAT U | E FAT block | E is D3 | E is not U | E as U | E and U | E or U", tern=" | E Q E : U | E Q",
) + """
D2: mod+ V | E X
D3: E | E ID
switch_tail: P switch { L }
"""
DART = C_BODY.format(
    iff="", types="int | double | void | bool | num | dynamic", xs="",
    stmts=" | import STR imp* ; | export STR imp* ; | part STR ; | part of L ; | library L ; | mod* class_def | try block catches | throw E ; | rethrow ; | D FAT E ; | D async block | D async PM block | D sync PM block | D async FAT E ; | D : ilist block | D : ilist ; | assert L ; | for await ( forhead ) stmt | yield E ; | mod* get_def | AT P stmt | AT P ( L? ) stmt",
    fors=" | D in L", mods="final | const | static | late | var | abstract | external | factory | covariant | required | override",
) + """
imp: as ID | show L | hide L | deferred
get_def: get ID block | get ID FAT E ; | E get ID block | E get ID FAT E ; | set ID ( L ) block | operator BIN ( L ) block
class_def: class ID gen? ext* { S } | mixin ID gen? ext* { S } | enum ID ext* enum_body | extension ID? on E { S } | typedef D ;
ext: extends L | implements L | with L | on L
gen: LT L GT
catches: catch_part+ | catch_part+ finally block | finally block
catch_part: catch ( L ) block | on E catch ( L ) block | on E block
ilist: E | ilist , E
""" + expr(
    prim=" | type | { L? } | [ L? ] | this | super | null | true | false | P NOT | P Q . ID | P STR | { props }", pres=" | await | throw | new | ELL | const",
    args=" | D2 | E : E | { L } | for ( forhead ) arg | if ( L ) arg", more=" | E GT | E is U | E is NOT U | E as U | E FAT U | E block_l | E Q", dots=" | DD | QDOT",
) + """
D2: mod+ V | E X
block_l: { S }
props: prop | props , prop | props ,
prop: E : E
"""

GO = """
file: end* package ID end top*
top: end | import STR end | import ID STR end | import ( imp* ) end | funcdef end | simple_decl end
imp: end | STR | ID STR | . STR
end: ; | NL
funcdef: func ID tpar? sig block | func ( params ) ID sig block | func ID tpar? sig | func ( params ) ID sig
tpar: [ params ]
sig: ( params? ) | ( params? ) T | ( params? ) ( params )
params: param | params , param | params ,
param: T | ID T | ID ELL T | ELL T
simple_decl: var vspec | var ( vspec_l ) | const vspec | const ( vspec_l ) | type tspec | type ( tspec_l )
vspec_l: | vspec_l end | vspec_l vspec end
vspec: idl | idl T | idl T ASG L | idl ASG L
idl: ID | idl , ID
tspec_l: | tspec_l end | tspec_l tspec end
tspec: ID T | ID ASG T | ID tpar T
T: ID | ID . ID | PM T | [ ] T | [ E ] T | [ ELL ] T | map [ T ] T | chan T | func sig | struct { field* } | interface { imeth* } | ID [ TL ] | LARR chan T | chan LARR T
TL: T | TL , T
field: end | idl T STR? end | T STR? end
imeth: end | ID sig end | T end | T BIN T end
block: { body }
body: S | S simple
S: | S stmt
stmt: end | simple end | block end | if_s end | for_s end | switch_s end | select { comm* } end | ID : stmt
simple: L | L ASG L | L INC | return L? | break ID? | continue ID? | goto ID | go E | defer E | simple_decl | L LARR L | fallthrough
if_s: if header block | if header block else if_s | if header block else block
header: HL | HS ; HL | ; HL
HS: HL | HL ASG HL | HL INC
HL: HE | HL , HE
for_s: for block | for HL block | for HS? ; HL? ; HS? block | for HL ASG range HL block | for range HL block
switch_s: switch header? { case_c* } | switch HS { case_c* } | switch HS ; { case_c* }
case_c: end | case L : body | case TSL : body | default : body
TSL: [ ] T | TSL , T
comm: end | case simple : body | default : body
E: U | E bop U
bop: BIN | PM | LT | GT
U: P | pre U
pre: PM | NOT | LARR
P: ID | NUM | STR | ( L? ) | ( T2 ) | P ( args? ) | P [ SL ] | P . ID | P . ( T ) | P . ( type ) | P { lits } | T2 { lits } | T2 ( L? ) | func sig block
T2: [ ] T | [ E ] T | [ ELL ] T | map [ T ] T | struct { field* } | PMT | chan T
PMT: interface { imeth* }
args: L | L ELL | T2 | T2 , L | L ELL ,
SL: L | E : | : E | : | E : E | E : E : E
lits: | lit | lits , lit | lits , | lits NL
lit: E | E : E | { lits } | E : { lits }
L: E | L , E | L ,
HE: HU | HE bop HU
HU: HP | pre HU
HP: ID | NUM | STR | ( L? ) | HP ( args? ) | HP [ SL ] | HP . ID | HP . ( T ) | HP . ( type ) | func sig block | T2 { lits }
"""
GO = GO.replace("L: E | L , E | L ,\n", "L: E | L , E\n").replace("P ( args? )", "P ( args? )").replace("args: L |", "args: L | L , |")

RUST = """
file: item*
item: vis? attr_item | ;
vis: pub | pub ( L )
attr_item: fn_def | use UT ; | mod ID ; | mod ID { item* } | struct_def | enum ID gen? where_c? { variants } | impl_def | trait_def | const ID : T ASG E ; | static mut? ID : T ASG E ; | type ID gen? ASG T ; | macro_item | extern crate ID ; | extern STR? { item* } | union ID { fields }
macro_item: ID NOT ID? { tokens } | P NOT ( L? ) ; | P NOT [ L? ] ;
tokens: | tokens stmt | tokens FAT | tokens ,
fn_def: fmod* fn ID gen? ( params ) ret? where_c? block | fmod* fn ID gen? ( params ) ret? where_c? ;
fmod: const | async | unsafe | extern STR | extern
ret: ARROW T
params: | param | params , param | params ,
param: pat : T | self | mut self | PM self | PM mut self | PM LIFE self | PM LIFE mut self | self : T | ELL
UT: ID | UT DC ID | UT DC PM | UT DC { UTL } | { UTL } | UT as ID | DC ID
UTL: | UT | UTL , UT | UTL ,
struct_def: struct ID gen? where_c? { fields } | struct ID gen? ( tfields ) where_c? ; | struct ID gen? ;
fields: | field | fields , field | fields ,
field: vis? ID : T
tfields: | vis? T | tfields , vis? T | tfields ,
variants: | variant | variants , variant | variants ,
variant: ID | ID ( tfields ) | ID { fields } | ID ASG E
impl_def: unsafe? impl gen? T where_c? { item* } | unsafe? impl gen? T for T where_c? { item* } | impl gen? NOT T for T { item* }
trait_def: unsafe? trait ID gen? bound? where_c? { item* }
bound: : TB
where_c: where wl
wl: w | wl , w | wl ,
w: T : TB | LIFE : TB
gen: LT gens GT
gens: | g | gens , g | gens ,
g: ID | ID : TB | LIFE | LIFE : TB | const ID : T | ID ASG T | ID : TB ASG T
TB: TBI | TB PM TBI
TBI: T | LIFE | Q T
T: TP | PM T | PM mut T | PM LIFE T | PM LIFE mut T | PM const T | ( TL ) | [ T ] | [ T ; E ] | dyn TB | impl TB | fn ( TL ) ret? | NOT | ID ( TL ) ret?
TP: ID | TP DC ID | DC ID | TP LT targs GT | TP DC LT targs GT | LT T as T GT DC ID | self
targs: | targ | targs , targ | targs ,
targ: T | LIFE | NUM | ID ASG T | { E }
TL: | T | TL , T | TL ,
pat: pat1 | pat BAR pat1 | BAR pat1
pat1: ID | mut ID | ref ID | ref mut ID | NUM | STR | PM pat1 | PM mut pat1 | ( pats ) | [ pats ] | PPATH ( pats ) | PPATH { fpats } | PPATH | DD | NUM DD NUM | ID AT_ pat1 | PM NUM | ID ( pats ) | ID { fpats } | true | false
PPATH: ID DC ID | PPATH DC ID
pats: | pat | pats , pat | pats ,
fpats: | fpat | fpats , fpat | fpats ,
fpat: ID | ID : pat | DD | mut ID | ref ID
block: { body }
body: S | S E
S: | S stmt
stmt: ; | let_s | E ; | BL | item_in | return E? ;
item_in: fn_def | use UT ; | struct_def | impl_def | const ID : T ASG E ; | static ID : T ASG E ; | enum ID gen? { variants } | type ID ASG T ;
let_s: let pat ty? init? ; | let pat ty? init else block ;
ty: : T
init: ASG E
BL: if_e | match HE { arms } | loop block | while HE block | while let pat ASG HE block | for pat in HE block | unsafe block | block | LIFE : loop block | LIFE : for pat in HE block | LIFE : while HE block
if_e: if cond block | if cond block else if_e | if cond block else block
cond: HE | let pat ASG HE | cond_l
cond_l: let pat ASG HE BIN HE
arms: | arms pat guard? FAT E , | arms pat guard? FAT block | arms pat guard? FAT E | arms pat guard? FAT return E? ,
guard: if HE
E: U | E bop U | E as T | return E | E DD | DD U | E DD U | break LIFE? | continue LIFE? | break E
bop: BIN | PM | ASG | LT | GT | BAR
U: P | pre U
pre: PM | NOT | PM mut | move | ref
P: ID | NUM | STR | true | false | self | ( L? ) | [ L? ] | [ E ; E ] | P ( L? ) | P [ E ] | P . ID | P . NUM | P . await | P Q | P DC ID | P DC LT targs GT | DC ID | P NOT ( L? ) | P NOT [ L? ] | P NOT [ E ; E ] | P { finits } | BIN2 E | lam | BLE | LT T GT DC ID | LT T as T GT DC ID
BLE: BL
lam: BAR lpars BAR E | BAR BAR E | BAR lpars BAR ARROW T block
lpars: lpar | lpars , lpar
lpar: pat1 | pat1 : T
BIN2: async_kw
finits: | finit | finits , finit | finits ,
finit: ID : E | ID | DD E
L: E | L , E | L ,
HE: HU | HE bop HU | HE as T | HE DD HU | HE DD
HU: HP | pre HU
HP: ID | NUM | STR | true | false | self | ( L? ) | [ L? ] | HP ( L? ) | HP [ E ] | HP . ID | HP . NUM | HP . await | HP Q | HP DC ID | HP DC LT targs GT | HP NOT ( L? ) | HP NOT [ L? ]
"""
RUST = RUST.replace(" | BIN2 E", "").replace("BIN2: async_kw\n", "")

PHP = """
file: S
S: | S stmt
block: { S }
stmt: ; | INLINE | L ; | echo L ; | print E ; | block | if ( L ) stmt | if ( L ) stmt else stmt | elseif_chain | for ( L? ; L? ; L? ) stmt | foreach ( E as E ) stmt | foreach ( E as E FAT E ) stmt | while ( L ) stmt | do stmt while ( L ) ; | switch ( E ) { case_part* } | return L? ; | break NUM? ; | continue NUM? ; | throw E ; | try block catches | fn_def | class_def | namespace ns ; | namespace ns block | use usel ; | use function usel ; | use const usel ; | const L ; | global L ; | static L ; | declare ( L ) ; | ID : | attr stmt | if ( L ) : S alt_tail | foreach ( E as E ) : S endforeach ; | foreach ( E as E FAT E ) : S endforeach ; | for ( L? ; L? ; L? ) : S endfor ; | while ( L ) : S endwhile ; | switch ( E ) : case_part* endswitch ;
alt_tail: endif ; | else : S endif ; | elseif ( L ) : S alt_tail
elseif_chain: if ( L ) stmt elseif ( L ) stmt | if ( L ) stmt elseif ( L ) stmt else stmt | if ( L ) stmt elseif ( L ) elseif_tail
elseif_tail: stmt elseif ( L ) elseif_tail | stmt elseif ( L ) stmt | stmt elseif ( L ) stmt else stmt
attr: HASHB L ]
ns: ID | ns BS ID | BS ID
usel: u | usel , u
u: ns | ns as ID | ns BS { usel }
case_part: case E : S | default : S
catches: catch_part+ | catch_part+ finally block | finally block
catch_part: catch ( T VAR? ) block
fn_def: function PM? ID ( params ) ret? block
ret: : T
params: | param | params , param | params ,
param: pm* VAR | pm* VAR ASG E | pm* T PM? ELL? VAR | pm* T PM? ELL? VAR ASG E | PM VAR | ELL VAR | PM VAR ASG E
pm: public | private | protected | readonly
T: TU | T BIN TU
TU: ns | Q ns | array | static | callable | null | self_t
self_t: selfkw
class_def: cmod* class ID ext* { member* } | interface ID ext* { member* } | trait ID { member* } | enum ID ext* { member* }
cmod: abstract | final | readonly
ext: extends nsl | implements nsl | : T
nsl: ns | nsl , ns
member: mm* function PM? ID ( params ) ret? block | mm* function PM? ID ( params ) ret? ; | mm+ T? props ; | mm* const L ; | use usel ; | case ID ; | case ID ASG E ; | attr member
mm: public | private | protected | static | abstract | final | readonly | var
props: p | props , p
p: VAR | VAR ASG E
E: U | E bop U | E Q E : U | E Q : U | E instanceof U
bop: BIN | PM | ASG | LT | GT | and | or | xor
U: P | pre U
pre: PM | NOT | INC | new | clone | AT | print | throw | yield | include | require | ELL | ( cast )
cast: array
P: VAR | ns | NUM | STR | ( L? ) | [ L? ] | array ( L? ) | P ( L? ) | P [ L? ] | P { E } | P ARROW ID | P ARROW VAR | P ARROW { E } | P DC ID | P DC VAR | P DC class | P INC | function PM? ( params ) uses? ret? block | fn ( params ) ret? FAT E | null | static | isset ( L ) | empty ( E ) | list ( L ) | match ( E ) { marms } | P QARROW ID | exit | class_anon | static fn ( params ) FAT E
class_anon: class ext* { member* } | class ( L? ) ext* { member* }
uses: use ( params )
marms: | marm | marms , marm | marms ,
marm: L FAT E | default FAT E
L: arg | L , arg | L ,
arg: E | E FAT E | ID : E | PM VAR | E FAT PM VAR
"""
PHP = PHP.replace(" | PM VAR | E FAT PM VAR", " | E FAT PM VAR")

RUBY = """
file: body
body: S | S expr_s
S: | S end_ | S expr_s end_
end_: NL | ;
expr_s: simple | expr_s if simple | expr_s unless simple | expr_s while simple | expr_s until simple | expr_s rescue simple
simple: E | cmd | E and simple | E or simple | cmd and simple | cmd or simple | not simple
cmd: P CL | return CL? | break E? | next E? | redo | retry | raise_c | yield CL | alias E E | E ASG cmd | E , L ASG L | E ASG L2 | P CL doblk
raise_c: super CL
L2: E , L
CL: carg | CL , carg
carg: EA | LABEL E | LABEL | EA FAT E | PM U
E: U | E bop U | E Q E : U | E Q E LABEL U | E LT U | E BAR U | defined E
bop: BIN | PM | ASG | GT | DD
U: P | pre U
pre: PM | NOT | NOT2 | STST
EA: UA | EA bop U | EA Q E : U | EA LT U | EA BAR U
UA: PA | NOT UA
PA: ID | NUM | strs | const_p | nil | true | false | self | super | [ L? ] | { hash } | PA ( L? ) | PA [ L? ] | PA dot ID | PA dot ID blk | ARROW lam | DC ID | PA { blockp? body } | yield | yield ( L? ) | PA dot class
const_p: __FILE__ | __method__
strs: STR | strs STR
lam: ( L? ) { body } | { body } | ( L? ) do body end | do body end
P: PA | ( body ) | P dot ID | P ( L? ) | P [ L? ] | P blk | P dot ( L? ) | block_e | P dot class
dot: . | QDOT | DC
blk: { blockp? body } | doblk
doblk: do blockp? body rescues? end
blockp: BAR bps BAR | BAR BAR
bps: bp | bps , bp | bps ; ID
bp: ID | PM ID | STST ID | LABEL | LABEL E1 | ID ASG E1 | ( bps )
E1: PA
block_e: if expr_s then_ body elsifs end | unless expr_s then_ body elsifs end | while expr_s do_ body end | until expr_s do_ body end | case expr_s? end_* whens else_p? end | for L in E do_ body end | begin body rescues? end | def dname dparams body rescues? end | def dname dparams ASG E | def dname ASG E | class cname super_c? end_ body end | class BIN E end_ body end | module cname end_ body end | pmod_def
pmod_def: ID def dname dparams body rescues? end
then_: end_ | then | end_ then
do_: end_ | do | end_ do
elsifs: else_p? | elsif expr_s then_ body elsifs
else_p: else body
whens: when_p+
when_p: when L then_ body | in L then_ body | in L if expr_s then_ body | in L unless expr_s then_ body
rescues: rescue_p+ else_p? ensure_p? | ensure_p | rescue_p+ ensure_p else_p
rescue_p: rescue rl? then_ body
rl: L | L FAT ID | FAT ID
ensure_p: ensure body
dname: ID | self . ID | ID . ID | BIN | PM | [ ] | ID ASG_NAME | LT | GT | class
dparams: end_ | ( dps ) | ( ) | dps end_ | ( dps ) end_
dps: dp | dps , dp
dp: ID | ID ASG E | PM ID | PM | STST ID | LABEL | LABEL E
cname: ID | cname DC ID
super_c: LT E
hash: | pair | hash , pair | hash ,
pair: E FAT E | LABEL E | LABEL | STR : E | STST E | LABEL E FAT ID | STST nil
L: arg | L , arg | L ,
arg: E | E FAT E | LABEL E | LABEL | cmd_a | STST nil | PM
cmd_a: not E
"""

KOTLIN = """
file: S
S: | S end | S stmt end | S stmt2
end: ; | NL
body: S | S stmt
block: { body }
stmt: package path | import path | import path . PM | import path as ID | decl | simple
stmt2: ctl_block
path: ID | path . ID
simple: E | return E? | throw E | break | continue | RETAT E? | BRKAT
decl: dmod* valvar gen? target ta? init? acc* | dmod* typealias ID gen? ASG T
valvar: val | var
target: ID | T . ID | ( L )
ta: : T
init: ASG E | by E
acc: NL? get ( ) ta? fbody | NL? set ( L ) fbody | NL? private set
ctl_block: fn_def | class_def
fn_def: dmod* fun gen? fname ( params ) ta? where_c? fbody | dmod* fun gen? fname ( params ) ta? end
fname: ID | T . ID
fbody: block | ASG E end | ASG E
where_c: where wl
wl: T : T | wl , T : T
class_def: dmod* ckw ID gen? ctor? supers? where_c? cbody | dmod* ckw ID gen? ctor? supers? end | dmod* companion object ID? supers? cbody | dmod* object ID supers? cbody | dmod* init block | dmod* constructor ( params ) deleg? block
ckw: class | interface | enum class | fun interface
ctor: ( params ) | dmod+ constructor ( params ) | constructor ( params )
deleg: : this ( L? ) | : super ( L? )
supers: : slist
slist: s_ | slist , s_
s_: T | T ( L? ) | T by E
cbody: { members }
members: body | elist NL? | elist ; body
elist: ID | ID ( L? ) | elist , ID | elist , ID ( L? ) | elist ,
dmod: public | private | protected | internal | open | abstract | final | override | suspend | inline | data | sealed | lateinit | const | operator | infix | tailrec | external | vararg | annotation | noinline | crossinline | expect | actual | annot | inner | value_
annot: AT ID | AT ID ( L? ) | AT ID : ID
params: | param | params , param | params ,
param: dmod* ID : T | dmod* ID : T ASG E | dmod* valvar ID : T | dmod* valvar ID : T ASG E
gen: LT TL GT
TL: gt_ | TL , gt_ | TL ,
gt_: T | in T | out T | PM | T : T | reified T
T: TP | ( tlist ) ARROW T | T . ( tlist ) ARROW T | suspend T
tlist: | ti | tlist , ti
ti: T | ID : T
TP: ID | TP . ID | TP gen | TP Q | ( T ) | dynamic
E: U | E bop U | E as T | E asq T | E is T | E nis T | E in U | E nin U | E GT | E ID U
bop: BIN | PM | ASG | LT | GT | ELVIS | DD
U: P | pre U
pre: PM | NOT | INC | annot | LABELAT
P: ID | NUM | STR | this | super | null | true | false | ( L? ) | P ( L? ) | P [ L ] | P dot ID | P INC | P NN | P lambda | P DC ID | P DC class | DC ID | lambda | fn_e | ctl | object supers? cbody | P dot ( L? ) | [ L? ]
fn_e: fun ( params ) ta? block
dot: . | QDOT
lambda: { lpars ARROW body } | { body }
lpars: lp | lpars , lp
lp: ID | ID : T | ( L )
ctl: if ( E ) branch | if ( E ) branch NL? else branch | if ( E ) ; else branch | when NL? { wcases } | when ( wsub ) { wcases } | try block tries | for ( L in E ) branch | for ( ID : T in E ) branch | for ( ( L ) in E ) branch | while ( E ) branch | do block while ( E )
wsub: E | val ID ASG E
branch: block | E | return E | throw E | return | break | continue
tries: catch_p+ | catch_p+ finally block | finally block
catch_p: catch ( ID : T ) block
wcases: | wcases end | wcases wc ARROW branch end | wcases wc ARROW branch
wc: wi | wc , wi
wi: E | in U | nin U | is T | nis T | else
L: arg | L , arg | L ,
arg: E
"""
KOTLIN = KOTLIN.replace("branch: block | E |", "branch: E |").replace(" | E ID U", " | E INFIX U").replace("for ( L in E )", "for ( ID in E )")

SWIFT = """
file: S
S: | S end | S stmt end | S stmt2
end: ; | NL
body: S | S stmt
block: { body }
stmt: import path | simple | decl
path: ID | path . ID
simple: E | return E? | throw E | break ID? | continue ID? | fallthrough | defer block
decl: dmod* letvar pats | dmod* typealias ID gen? ASG T | dmod* case cases | dmod* associatedtype ID ta?
cases: ci | cases , ci
ci: ID | ID ( params ) | ID ASG E
letvar: let | var
pats: pt | pats , pt
pt: tgt ta? | tgt ta? ASG E | tgt ta? accs | tgt ta? ASG E accs
tgt: ID | ( L )
accs: { acc+ } | { body }
acc: end | get block | set block | set ( ID ) block | get | set | didSet block | willSet block | get throws
ta: : T
stmt2: fn_def | class_def | ctl
fn_def: dmod* func ID gen? ( params ) thr? ret? where_c? block | dmod* func ID gen? ( params ) thr? ret? where_c? end | dmod* init Q? gen? ( params ) thr? block | dmod* init Q? ( params ) end | dmod* deinit block | dmod* subscript ( params ) ret accs | dmod* func BIN ( params ) ret? block
thr: throws | async | async throws | rethrows
ret: ARROW T
where_c: where L
class_def: dmod* ckw T ta2? where_c? { body }
ta2: : TL
ckw: class | struct | enum | protocol | extension | actor | indirect enum
dmod: public | private | fileprivate | internal | open | static | final | override | mutating | lazy | weak | unowned | required | convenience | class_m | annot | dynamic | optional | nonmutating | private ( ID ) | prefix
annot: AT ID | AT ID ( L? ) | AT ID NL | AT ID ( L? ) NL
params: | param | params , param | params ,
param: pn : pm* T | pn : pm* T ASG E | pn : T ELL
pm: inout | annot
pn: ID | ID ID
gen: LT TL GT
TL: ti | TL , ti | TL BIN ti | TL PM ti
ti: T | T : T
T: TP | ( tl2 ) ARROW T | ( tl2 ) throws ARROW T | some TP | any TP
tl2: | t2 | tl2 , t2
t2: T | ID : T | ID ID : T | annot T | inout T
TP: ID | TP . ID | TP gen | TP Q | TP NOT | [ T ] | [ T : T ] | ( tl2 )
ctl: if conds block | if conds block else ctl_else | guard conds else block | for pat in E2 block | for pat in E2 where E2 block | while conds block | repeat block while E | switch E2 { scase* } | do block catches | do block | ID : ctl
ctl_else: block | if conds block | if conds block else ctl_else
conds: cond | conds , cond
cond: E2 | let ID ta? | let ID ta? ASG E2 | var ID ASG E2 | case E2 ASG E2 | let ( L ) ASG E2
pat: ID | ( L ) | case E2 | let ID
scase: end | case cps : body | default : body | AT ID default : body
cps: cp | cps , cp
cp: E2 | let ID | E2 where E2 | is T
catches: catch_p+
catch_p: catch block | catch E2 block | catch let ID block
E: U | E bop U | E as T | E asq T | E is T | E Q E : U | E GT
bop: BIN | PM | ASG | LT | GT | DD
U: P | pre U
pre: PM | NOT | try | try Q | try NOT | await | let
P: ID | NUM | STR | self | super | nil | true | false | . ID | ( L? ) | [ L? ] | [ : ] | P ( L? ) | P [ L ] | P . ID | P . self | P . init | P Q | P NOT | P clos | clos | P . NUM | ctl_e
ctl_e: SWX
clos: { body } | { cparams in body } | { body2 }
cparams: ID | cparams , ID | ( params ) | ( L ) | ( params ) ret | [ L ] ID | [ L ] | [ L ] ( L )
body2: BIN
L: arg | L , arg | L ,
arg: E | ID : E | STR : E | NUM : E | E : E | PM ID | BIN | PM | ID NUM | ID NUM . NUM
E2: U2 | E2 bop U2 | E2 as T | E2 asq T | E2 is T | E2 Q E2 : U2
U2: P2 | pre U2
P2: ID | NUM | STR | self | super | nil | true | false | . ID | ( L? ) | [ L? ] | P2 ( L? ) | P2 [ L ] | P2 . ID | P2 . self | P2 Q | P2 NOT
"""
SWIFT = SWIFT.replace(" | ctl_e", "").replace("ctl_e: SWX\n", "").replace(" | { body2 }", "").replace("body2: BIN\n", "").replace("arg: E | ID : E | STR : E | NUM : E | E : E", "arg: E | E : E")

SCALA = """
file: S
S: | S end | S stmt end | S stmt2
end: ; | NL
body: S | S stmt
block: { body }
stmt: package path | import imps | decl | simple
stmt2: package path block | class_def
imps: path | path . { L } | path . PM | imps , path
path: ID | path . ID | path . this
simple: E | return E? | throw E
decl: dmod* valvar pat ta? | dmod* valvar pat ta? ASG E | dmod* def dn gen? clause* ta? ASG E | dmod* def dn gen? clause* ta? | dmod* def dn gen? clause* block | dmod* type ID gen? ASG T | dmod* type ID gen? | given ID : T ASG E | given T ASG E | given ID : T with tbody | given T with tbody
dn: ID | BIN | PM | this
valvar: val | var
pat: ID | ( L ) | ID ( L ) | pat , ID
ta: : T
clause: ( params ) | ( implicit params ) | ( using params )
params: | param | params , param | params ,
param: dmod* ID : T | dmod* ID : T ASG E | dmod* valvar ID : T | dmod* valvar ID : T ASG E | dmod* ID : FAT T
class_def: dmod* ckw ID gen? clause* exts* tbody | dmod* ckw ID gen? clause* exts* end | dmod* enum ID gen? clause* exts* { ebody }
ebody: | ebody end | ebody case ecases | ebody stmt | ebody stmt2
ecases: ec | ecases , ec
ec: ID gen? clause* exts*
ckw: class | trait | object | case class | case object
exts: extends sup | with sup
sup: T | T ( L? )
tbody: { body } | { ID FAT body } | { ID : T FAT body }
dmod: private | protected | override | final | sealed | abstract | implicit | lazy | annot | private [ ID ] | protected [ ID ] | inline
annot: AT ID | AT ID ( L? )
gen: [ TL ]
TL: ti | TL , ti
ti: T | PM T | T BIN T | T LT T | T : T | T ASG T
T: TP | TP FAT T | ( tl2 ) FAT T | T with TP
tl2: | T | tl2 , T
TP: ID | TP . ID | TP gen | ( T ) | ( tl2 , T ) | TP PM | TP HASH ID
E: U | E bop U | E match { cases } | E ID U | E FAT U | E : T | E FATB
bop: BIN | PM | ASG | LT | GT
U: P | pre U
pre: PM | NOT | new
P: ID | NUM | STR | this | super | null | true | false | ( L? ) | P ( L? ) | P [ TL ] | P . ID | P . NL? ID | block | { cases } | P block | P { cases } | { lam } | P { lam } | ctl | P . this | P . match { cases } | us
us: UNDERSCORE
lam: lp FAT body | implicit ID FAT body
lp: ID | ( L ) | ID : T
cases: case_c+
case_c: NL | case cpat guard? FAT body
cpat: E2 | cpat BIN E2
E2: P2 | P2 : T | ID AT P2 | E2 ID P2 | PM NUM
P2: ID | NUM | STR | ( L? ) | P2 ( L? ) | P2 . ID | null | true | false | P2 [ TL ]
guard: if E
ctl: if ( E ) E | if ( E ) E NL? else E | for ( enums ) E | for ( enums ) yield E | for { enums } E | for { enums } yield E | while ( E ) E | do E while ( E ) | try E tries
enums: en | enums en | enums end
en: pat LARR E | pat ASG E | if E
tries: | catch { cases } | catch { cases } finally E | finally E
L: arg | L , arg | L ,
arg: E
"""
SCALA = SCALA.replace(" | E FATB", "").replace(" | us", "").replace("us: UNDERSCORE\n", "").replace(" | E ID U", " | E INFIX U").replace(" | E2 ID P2", " | E2 INFIX P2")

GRAMMARS = {
    "python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST, "java": JAVA, "c": C, "cpp": CPP,
    "csharp": CSHARP, "ruby": RUBY, "php": PHP, "swift": SWIFT, "kotlin": KOTLIN, "scala": SCALA, "dart": DART,
}

#: Words that are keywords in some places and names in all others.
SOFT = {
    "javascript": "async of from as static target",
    "typescript": "async of from as static type declare keyof infer satisfies namespace module abstract readonly is await public private protected interface extends_",
    "java": "record permits sealed annotation",
    "csharp": "record get set init where when async await partial dynamic nameof required yield and or not string_ unsafe_ event_ file",
    "dart": "part of library show hide on async sync get set mixin extension required late factory external abstract covariant operator deferred typedef await yield dynamic export import_ num_",
    "kotlin": "by get set where init constructor companion data open inner value_ annotation enum out reified inline operator infix external expect actual dynamic sealed catch finally import_ suspend final abstract override lateinit internal public private protected vararg noinline crossinline tailrec const",
    "swift": "get set didSet willSet lazy open optional required convenience mutating some any actor indirect prefix dynamic weak unowned final override async nonmutating path",
    "scala": "inline given enum using",
    "rust": "union default async",
    "php": "enum match readonly print_ list_ ns",
    "c": "bool",
    "cpp": "final override noexcept size_t default_",
    "python": "type",
}
